"""Chat sample, batching and hand-off queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.functions import chat
from captrellis.functions.hashing import pick
from captrellis.functions.text import tokens
from captrellis.operators import batching, ordering
from captrellis.operators.inference import predict, predict_journaled
from captrellis.operators.skew import first_k
from captrellis.plans.jobs import chat_samples as build_samples
from captrellis.plans.jobs import image_tokens, with_few_shots
from captrellis.queries.twins import draw, order_key, quoted, tok
from captrellis.session import stage, stage_path
from captrellis.sources.tables import read_table

SEED = 5


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """``conv_id, turn, user, assistant``: every user turn that an assistant turn follows directly.

    Turns meet by ``(conv_id, turn)``, which is unique, so a very long
    conversation is spread like any other rows.
    """
    turns = read_table(spark, f"{d}/conversations.parquet")
    asked = turns.where(F.col("role") == "user").select("conv_id", F.col("turn") + 1, F.col("text").alias("user")).toDF(
        "conv_id", "turn", "user"
    )
    told = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("assistant"))
    return asked.join(told, ["conv_id", "turn"])


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    """``conv_id, user, assistant``: the pair that a sample is built from, the first of its conversation."""
    return first_k(pairs(spark, d), ["conv_id"], ["turn"], 1).select("conv_id", "user", "assistant")


def mixed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues (``texts``) and plain captions (``caption``) in one table."""
    said = dialogues(spark, d).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit("ln/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.array(F.struct("user", "assistant")).alias("texts"),
        F.lit(None).cast("string").alias("caption"),
    )
    docs = read_table(spark, f"{d}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("px/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.lit(None).cast(said.schema["texts"].dataType).alias("texts"),
        F.col("text").alias("caption"),
    )
    return said.unionByName(docs)


def prompt_choice(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id"])
    return docs.withColumn("prompt", chat.random_prompt(SEED, "doc_id"))


def few_shot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two pairs of turns drawn for every pair of turns."""
    named = pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"))
    drawn = ordering.few_shot_draws(named, "pair_id", 2, SEED)
    return drawn.select("pair_id", F.col("shot").cast("bigint").alias("shot"), "shot_pair_id")


def _exploded(samples: DataFrame, key: str) -> DataFrame:
    return (
        samples.select(key, F.posexplode("messages").alias("msg", "m"))
        .select(key, "msg", "m.role", F.posexplode("m.content").alias("element", "e"))
        .select(
            key,
            F.col("msg").cast("bigint").alias("msg"),
            "role",
            F.col("element").cast("bigint").alias("element"),
            "e.type",
            "e.image",
            F.md5("e.text").alias("text_md5"),
        )
    )


def chat_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three-message samples, one row per content element."""
    return _exploded(build_samples(mixed_samples(spark, d), "id", SEED), "id")


def evaluation_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with at least two assistant turns; these are the answers."""
    said = read_table(spark, f"{d}/conversations.parquet").where(F.col("role") == "assistant")
    return (
        said.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("pairs"))
        .where(F.size("pairs") >= 2)
        .select(
            "conv_id",
            F.concat(F.lit("img/"), F.col("conv_id").cast("string")).alias("image"),
            F.transform("pairs", lambda p: p["text"]).alias("answer"),
        )
    )


def few_shot_messages(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation samples behind two example captions, with the images gathered over all messages."""
    items = with_few_shots(evaluation_items(spark, d), "conv_id", 2, SEED)
    samples = build_samples(items, "conv_id", test_set=True, few_shot=chat.few_shot_from_answers(F.col("shots")))
    gathered = samples.select("conv_id", F.array_join(chat.gather_images(F.col("messages")), ",").alias("images"))
    return _exploded(samples, "conv_id").where(F.col("role") == "user").drop("role", "msg").join(gathered, "conv_id")


def render_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole samples as training text, and the user message alone as evaluation prompt."""
    samples = build_samples(mixed_samples(spark, d), "id", SEED)
    m = F.col("messages")
    shown = samples.select(
        "id",
        chat.render(m).alias("train"),
        chat.render(chat.prompt_part(m), add_generation_prompt=True).alias("prompt"),
        chat.answer_text(m).alias("answer"),
        chat.image_of(m).alias("image"),
    )
    return shown.select(
        "id",
        F.md5("train").alias("train_md5"),
        F.length("train").cast("bigint").alias("train_length"),
        F.md5("prompt").alias("prompt_md5"),
        F.md5("answer").alias("answer_md5"),
        "image",
    )


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, f"{d}/benchmark.parquet").select(tokens("text").alias("t"))
    return stage(batching.build_vocab(words, "t"), "vocab")


def vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents ranked by count, behind the special tokens."""
    words = read_table(spark, f"{d}/documents.parquet").select(tokens("text").alias("t"))
    return batching.build_vocab(words, "t").select("token", F.col("id").cast("bigint").alias("id"), "is_special")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """Documents behind one image marker, as ids of the ``benchmark`` vocabulary."""
    marked = F.concat(F.lit("<image>"), F.col("text"))
    docs = read_table(spark, f"{d}/documents.parquet")
    return batching.encode(docs, _vocab(spark, d), ["doc_id"], image_tokens(marked))


def _md5(ids: str):
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ","))


def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _md5("ids").alias("ids_md5"))


def _padded(spark: SparkSession, d: str, side: str) -> DataFrame:
    ids = stage(_encoded(spark, d), "encoded")
    return batching.padded(batching.batched(ids, "doc_id", 6), side=side)


def _batch_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "batch_id",
        F.size("input_ids").cast("bigint").alias("width"),
        _md5("input_ids").alias("input_md5"),
        _md5("attention_mask").alias("mask_md5"),
    )


def batch_pad_left(spark: SparkSession, d: str) -> DataFrame:
    return _batch_columns(_padded(spark, d, "left"))


def batch_pad_right(spark: SparkSession, d: str) -> DataFrame:
    return _batch_columns(_padded(spark, d, "right"))


def label_mask(spark: SparkSession, d: str) -> DataFrame:
    labels = _padded(spark, d, "right").withColumn("labels", batching.label_mask("input_ids"))
    ignored = F.size(F.filter("labels", lambda x: x == batching.IGNORED_LABEL))
    return labels.select("doc_id", ignored.cast("bigint").alias("n_ignored"), _md5("labels").alias("labels_md5"))


def trim_decode(spark: SparkSession, d: str) -> DataFrame:
    """Output ids are prompt and answer of a pair of turns; the prompt is cut off and the rest read back."""
    vocab = _vocab(spark, d)
    said = pairs(spark, d).select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit("in").alias("part"), tokens("user").alias("t")),
        F.struct(F.lit("out").alias("part"), F.concat(tokens("user"), F.array(F.lit("<pad>")), tokens("assistant")).alias("t")),
    )).alias("p")).select("conv_id", "turn", "p.part", "p.t")
    ids = batching.encode(said, vocab, ["conv_id", "turn", "part"], "t")
    both = ids.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("part") == "in", F.col("ids"))).alias("input_ids"),
        F.max(F.when(F.col("part") == "out", F.col("ids"))).alias("output_ids"),
    )
    trimmed = both.select("conv_id", "turn", batching.trim_prompt("output_ids", "input_ids").alias("ids"))
    text = batching.decode(trimmed, vocab, ["conv_id", "turn"])
    return text.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.length("text").cast("bigint").alias("length"), F.md5("text").alias("text_md5"))


def toy_reverser():
    """Answers with the words of the prompt from last to first."""

    def run(prompts: list[str], images: list | None) -> list[str]:
        return [" ".join(reversed(p.split(" "))) for p in prompts]

    return run


def batch_predict(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", F.array_join(tokens("text"), " ").alias("prompt"))
    preds = predict(docs, toy_reverser, "doc_id", "prompt", batch_size=16)
    return preds.select("doc_id", F.length("pred").cast("bigint").alias("length"), F.md5("pred").alias("pred_md5"))


def predict_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A run over a part of ``documents``, then one over all of them with the same journal: it asks only the rest."""
    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", F.array_join(tokens("text"), " ").alias("prompt"))
    journal = stage_path(spark, "journal")
    predict_journaled(docs.where(pick(3, "cut", "doc_id") == 0), toy_reverser, "doc_id", "prompt", batch_size=16, journal=journal, slices=2)
    preds = predict_journaled(docs, toy_reverser, "doc_id", "prompt", batch_size=16, journal=journal, slices=2)
    return preds.select("doc_id", F.length("pred").cast("bigint").alias("length"), F.md5("pred").alias("pred_md5"))


QUERIES = {
    "prompt_choice": prompt_choice,
    "few_shot_pairs": few_shot_pairs,
    "chat_samples": chat_samples,
    "few_shot_messages": few_shot_messages,
    "render_prompts": render_prompts,
    "vocab_ids": vocab_ids,
    "encode_ids": encode_ids,
    "batch_pad_left": batch_pad_left,
    "batch_pad_right": batch_pad_right,
    "label_mask": label_mask,
    "trim_decode": trim_decode,
    "batch_predict": batch_predict,
    "predict_resumed": predict_resumed,
}

_PROMPTS = "[" + ", ".join(quoted(p) for p in chat.PROMPTS) + "]"


def _prompt(key: str) -> str:
    return f"{_PROMPTS}[{draw(len(chat.PROMPTS), SEED, key)} + 1]"


_PAIRS = """
    pairs AS (
      SELECT u.conv_id, a.turn, u.conv_id || ':' || a.turn AS pair_id, u.text AS user_text, a.text AS assistant
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'
    )"""

_DIALOGUES = f"""{_PAIRS},
    dialogues AS (
      SELECT conv_id, user_text, assistant FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
    )"""

_MIXED = f"""{_DIALOGUES},
    mixed AS (
      SELECT 'c' || conv_id AS id, 'ln/' || conv_id || '.jpg' AS image, user_text AS question, assistant AS reply FROM dialogues
      UNION ALL
      SELECT 'd' || doc_id, 'px/' || doc_id || '.jpg', {_prompt("'d' || doc_id")}, text FROM documents
    )"""

_SYSTEM = quoted(chat.SYSTEM_MESSAGE)

_EVAL = f"""
    said AS (
      SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant'
    ),
    items AS (
      SELECT a.conv_id, 'img/' || a.conv_id AS image, a.text AS one, b.text AS two
      FROM said a JOIN said b ON a.conv_id = b.conv_id AND a.k = 1 AND b.k = 2
    ),
    numbered AS (SELECT *, row_number() OVER (ORDER BY {order_key(SEED, 'conv_id')}) AS rn, count(*) OVER () AS n FROM items),
    shots AS (
      SELECT q.conv_id, s.image AS image1, s.one AS caption1, t.two AS caption2
      FROM numbered q
      JOIN numbered s ON s.rn = {draw('q.n', SEED, 'q.conv_id', '1')} + 1
      JOIN numbered t ON t.rn = {draw('q.n', SEED, 'q.conv_id', '2')} + 1
    ),
    elements AS (
      SELECT conv_id, 0 AS element, 'image' AS type, image1 AS image, NULL AS text FROM shots
      UNION ALL SELECT conv_id, 1, 'text', NULL, {quoted(chat.FIRST_EXAMPLE)} || caption1 FROM shots
      UNION ALL SELECT conv_id, 2, 'image', image1, NULL FROM shots
      UNION ALL SELECT conv_id, 3, 'text', NULL, {quoted(chat.SECOND_EXAMPLE)} || caption2 FROM shots
      UNION ALL SELECT conv_id, 4, 'image', image, NULL FROM items
      UNION ALL SELECT conv_id, 5, 'text', NULL, {quoted(chat.EVAL_QUESTION)} FROM items
    )"""

_VOCAB = f"""
    words AS (SELECT unnest({tok('text')}) AS token FROM benchmark),
    vocab AS (
      SELECT token, row_number() OVER (ORDER BY uses DESC, token) + 2 AS id FROM (SELECT token, count(*) AS uses FROM words GROUP BY 1)
    )"""

_ENCODED = f"""{_VOCAB},
    spread AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {tok('text')} AS t FROM documents)),
    looked AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM spread LEFT JOIN vocab USING (token)),
    packed AS (SELECT doc_id, list(id ORDER BY pos) AS l FROM looked GROUP BY 1),
    encoded AS (SELECT doc_id, list_concat([2], coalesce(l, [])) AS ids FROM documents LEFT JOIN packed USING (doc_id))"""

_BATCHED = f"""{_ENCODED},
    rows AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 6 AS batch_id FROM encoded),
    sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM rows),
    padded AS (
      SELECT doc_id, batch_id, width, ids, list_transform(range(width - len(ids)), lambda x: 0) AS fill,
             list_transform(ids, lambda x: 1) AS ones
      FROM sized
    )"""


def _batch_sql(first: str, second: str) -> str:
    parts = {"ids": "ids", "fill": "fill"}
    masks = {"ids": "ones", "fill": "fill"}
    return f"""WITH {_BATCHED}
        SELECT doc_id, batch_id::BIGINT AS batch_id, width::BIGINT AS width,
               md5(array_to_string(list_concat({parts[first]}, {parts[second]}), ',')) AS input_md5,
               md5(array_to_string(list_concat({masks[first]}, {masks[second]}), ',')) AS mask_md5
        FROM padded"""


_EOT = "'<end_of_utterance>' || chr(10)"

ORACLES = {
    "prompt_choice": f"SELECT doc_id, {_prompt('doc_id')} AS prompt FROM documents",
    "few_shot_pairs": f"""WITH {_PAIRS},
        numbered AS (SELECT pair_id, row_number() OVER (ORDER BY {order_key(SEED, 'pair_id')}) AS rn, count(*) OVER () AS n FROM pairs),
        asked AS (SELECT pair_id, n, unnest([1, 2])::BIGINT AS shot FROM numbered)
        SELECT a.pair_id, a.shot, s.pair_id AS shot_pair_id
        FROM asked a JOIN numbered s ON s.rn = {draw('a.n', SEED, 'a.pair_id', 'a.shot')} + 1""",
    "chat_samples": f"""WITH {_MIXED}
        SELECT id, 0::BIGINT AS msg, 'system' AS role, 0::BIGINT AS element, 'text' AS type, NULL::VARCHAR AS image, md5({_SYSTEM}) AS text_md5 FROM mixed
        UNION ALL SELECT id, 1, 'user', 0, 'image', image, NULL FROM mixed
        UNION ALL SELECT id, 1, 'user', 1, 'text', NULL, md5(question) FROM mixed
        UNION ALL SELECT id, 2, 'assistant', 0, 'text', NULL, md5(reply) FROM mixed""",
    "few_shot_messages": f"""WITH {_EVAL}
        SELECT e.conv_id, e.element::BIGINT AS element, e.type, e.image, md5(e.text) AS text_md5,
               image1 || ',' || image1 || ',' || 'img/' || e.conv_id AS images
        FROM elements e JOIN shots USING (conv_id)""",
    "render_prompts": f"""WITH {_MIXED}, shown AS (
          SELECT *, 'System: ' || {_SYSTEM} || {_EOT} || 'User: <image>' || question || {_EOT} || 'Assistant: ' || reply
                 || '<end_of_utterance>' AS train,
                 'User: <image>' || question || {_EOT} || 'Assistant:' AS prompt
          FROM mixed
        )
        SELECT id, md5(train) AS train_md5, length(train)::BIGINT AS train_length, md5(prompt) AS prompt_md5, md5(reply) AS answer_md5, image
        FROM shown""",
    "vocab_ids": f"""WITH words AS (SELECT unnest({tok('text')}) AS token FROM documents),
        counted AS (SELECT token, count(*) AS uses FROM words GROUP BY 1)
        SELECT token, (row_number() OVER (ORDER BY uses DESC, token) + 2)::BIGINT AS id, false AS is_special FROM counted
        UNION ALL SELECT unnest(['<pad>', '<unk>', '<image>']), unnest([0, 1, 2]), true""",
    "encode_ids": f"""WITH {_ENCODED}
        SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM encoded""",
    "batch_pad_left": _batch_sql("fill", "ids"),
    "batch_pad_right": _batch_sql("ids", "fill"),
    "label_mask": f"""WITH {_BATCHED}, masked AS (
          SELECT doc_id, list_transform(list_concat(ids, fill), lambda x: CASE WHEN x IN (0, 2) THEN -100 ELSE x END) AS labels FROM padded
        )
        SELECT doc_id, len(list_filter(labels, lambda x: x = -100))::BIGINT AS n_ignored, md5(array_to_string(labels, ',')) AS labels_md5
        FROM masked""",
    "trim_decode": f"""WITH {_PAIRS}, {_VOCAB},
        spread AS (
          SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos
          FROM (SELECT conv_id, turn, {tok('assistant')} AS t FROM pairs)
        ),
        joined AS (SELECT conv_id, turn, string_agg(token, ' ' ORDER BY pos) AS text FROM spread JOIN vocab USING (token) GROUP BY 1, 2)
        SELECT conv_id, turn::BIGINT AS turn, length(coalesce(text, ''))::BIGINT AS length, md5(coalesce(text, '')) AS text_md5
        FROM pairs LEFT JOIN joined USING (conv_id, turn)""",
    "batch_predict": f"""WITH p AS (SELECT doc_id, array_to_string(list_reverse({tok('text')}), ' ') AS pred FROM documents)
        SELECT doc_id, length(pred)::BIGINT AS length, md5(pred) AS pred_md5 FROM p""",
}
ORACLES["predict_resumed"] = ORACLES["batch_predict"]
