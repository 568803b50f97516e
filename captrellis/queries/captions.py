"""Caption metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.functions.hashing import pick
from captrellis.functions.text import normalize, tokens
from captrellis.operators import cider, frequency
from captrellis.operators.skew import salted_join
from captrellis.plans.jobs import evaluate_captions
from captrellis.queries.twins import cider_scores, cider_tables, draw, tok
from captrellis.session import stage_path
from captrellis.sources.tables import read_table


def conversation_captions(spark: SparkSession, d: str) -> cider.Captions:
    """First assistant turn as candidate, the later ones as references; at least two of them."""
    said = spark.read.parquet(f"{d}/conversations.parquet").where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("item_id"), "turn", "text"
    )
    firsts = (
        said.groupBy("item_id")
        .agg(F.min("turn").alias("_first"), F.min_by("text", "turn").alias("pred"), F.count("*").alias("_turns"))
        .where(F.col("_turns") >= 2)
        .select("item_id", "pred", "_first")
    )
    pairs = salted_join(said, firsts, ["item_id"], spread_by=["turn"]).where(F.col("turn") > F.col("_first"))
    return cider.Captions(
        firsts.select("item_id", "pred"),
        pairs.select("item_id", "pred", F.col("turn").cast("int").alias("ref_no"), F.col("text").alias("ref")),
    )


def _scored(scores: DataFrame) -> DataFrame:
    return scores.select("item_id", F.col("n_refs").cast("bigint").alias("n_refs"), F.round("cider", 6).alias("cider"))


def cider_items(spark: SparkSession, d: str) -> DataFrame:
    return _scored(cider.score_items(conversation_captions(spark, d)))


def cider_corpus(spark: SparkSession, d: str) -> DataFrame:
    scores = cider.score_items(conversation_captions(spark, d))
    return cider.score_corpus(scores).select("items", F.round("cider", 6).alias("cider"))


def cider_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth token of a document changed, scored against the document itself."""
    docs = read_table(spark, f"{d}/documents.parquet")
    # The text stays as it is between the tokens; five of them are one match.
    five = r"((?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){4}[\p{L}\p{N}]++)"
    changed = F.regexp_replace(F.lower(normalize("text")), five, "$1x")
    items = docs.select(F.col("doc_id").alias("item_id"), changed.alias("pred"), F.array("text").alias("refs"))
    return _scored(cider.score_items(cider.captions_from_arrays(items)))


def caption_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", tokens("text").alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


def _assistant_refs(spark: SparkSession, d: str) -> DataFrame:
    said = spark.read.parquet(f"{d}/conversations.parquet").where(F.col("role") == "assistant")
    return said.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ref_no"), F.col("text").alias("ref"))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and all 1- to 4-grams per assistant turn and length."""
    counted = cider.reference_grams(cider.reference_words(_assistant_refs(spark, d)))
    return counted.groupBy("item_id", "ref_no", F.col("n").cast("bigint").alias("n")).agg(
        F.count("*").alias("grams"), F.sum("tf").alias("occurrences")
    )


def ngram_df(spark: SparkSession, d: str) -> DataFrame:
    """1- to 4-grams that occur in the assistant turns of at least two conversations."""
    freq = cider.document_frequency(cider.reference_words(_assistant_refs(spark, d))).where(F.col("df") >= 2)
    return freq.select(F.size(F.split("gram", " ")).cast("bigint").alias("n"), "gram", "df")


def cider_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Scores with frequencies from a store that items were added to in two changes and partly withdrawn from."""
    caps = conversation_captions(spark, d)
    store = stage_path(spark, "frequency")
    ids, refs = caps.cands.select("item_id"), caps.pairs.select("item_id", "ref_no", "ref")
    late, gone = pick(3, "late", "item_id") == 0, pick(5, "withdrawn", "item_id") == 0
    frequency.add_items(store, "first", ids.where(~late), refs)
    frequency.add_items(store, "second", ids.where(late), refs)
    frequency.withdraw_items(store, "withdrawn", ids.where(gone), refs)
    left = cider.Captions(caps.cands.where(~gone), caps.pairs.where(~gone))
    return _scored(cider.score_items(left, frequency=frequency.read_frequency(spark, store)))


def tfidf_norms(spark: SparkSession, d: str) -> DataFrame:
    norms = cider.sentence_norms(conversation_captions(spark, d))
    return norms.select(
        "item_id", F.col("ref_no").cast("bigint").alias("ref_no"), F.col("n").cast("bigint").alias("n"),
        F.round("norm", 6).alias("norm"),
    )


def toy_captioner():
    """Reads the caption from the image path: its parts after the first one."""

    def caption(prompts: list[str], images: list) -> list[str]:
        return [" ".join(paths[0].split("/")[1:]) for paths in images]

    return caption


def evaluate_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a document are its reference captions; the toy predictor names the words of the first line."""
    docs = read_table(spark, f"{d}/documents.parquet")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    items = (
        docs.select(F.col("doc_id").alias("item_id"), lines.alias("answer"))
        .where(F.size("answer") > 0)
        .select("item_id", "answer", F.concat_ws("/", F.lit("img"), tokens(F.get("answer", F.lit(0)))).alias("image"))
    )
    scores, _ = evaluate_captions(items, toy_captioner)
    return _scored(scores)


QUERIES = {
    "cider_items": cider_items,
    "cider_corpus": cider_corpus,
    "cider_perturbed": cider_perturbed,
    "caption_tokens": caption_tokens,
    "ngram_counts": ngram_counts,
    "ngram_df": ngram_df,
    "cider_incremental": cider_incremental,
    "tfidf_norms": tfidf_norms,
    "evaluate_end_to_end": evaluate_end_to_end,
}

_CONVERSATIONS = """
    said AS (SELECT conv_id AS item_id, turn, text FROM conversations WHERE role = 'assistant'),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY item_id) AS turns
      FROM said
    ),
    cand AS (SELECT item_id, text FROM numbered WHERE k = 1 AND turns >= 2),
    refs AS (SELECT item_id, turn AS ref_no, text FROM numbered WHERE k > 1)"""

_ITEM_SCORES = "SELECT item_id, n_refs::BIGINT AS n_refs, round(cider, 6) AS cider FROM scores"

ORACLES = {
    "cider_items": f"WITH {_CONVERSATIONS}, {cider_scores()} {_ITEM_SCORES}",
    "cider_corpus": f"""WITH {_CONVERSATIONS}, {cider_scores()}
        SELECT count(*) AS items, round(avg(cider), 6) AS cider FROM scores""",
    "cider_perturbed": f"""WITH
        cand AS (
          SELECT doc_id AS item_id,
                 array_to_string(list_transform({tok('text')}, lambda w, i: CASE WHEN i % 5 = 0 THEN w || 'x' ELSE w END), ' ') AS text
          FROM documents
        ),
        refs AS (SELECT doc_id AS item_id, 0 AS ref_no, text FROM documents),
        {cider_scores()} {_ITEM_SCORES}""",
    "cider_incremental": f"""WITH
        said AS (
          SELECT conv_id AS item_id, turn, text FROM conversations
          WHERE role = 'assistant' AND {draw(5, 'withdrawn', 'conv_id')} <> 0
        ),
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY item_id) AS turns
          FROM said
        ),
        cand AS (SELECT item_id, text FROM numbered WHERE k = 1 AND turns >= 2),
        refs AS (SELECT item_id, turn AS ref_no, text FROM numbered WHERE k > 1),
        {cider_scores()} {_ITEM_SCORES}""",
    "caption_tokens": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {tok('text')} AS t FROM documents)""",
    "ngram_counts": f"""WITH
        cand AS (SELECT conv_id AS item_id, '' AS text FROM conversations WHERE false),
        refs AS (SELECT conv_id AS item_id, turn AS ref_no, text FROM conversations WHERE role = 'assistant'),
        {cider_tables()}
        SELECT item_id, ref_no, n::BIGINT AS n, count(*) AS grams, sum(tf)::BIGINT AS occurrences FROM grams GROUP BY ALL""",
    "ngram_df": f"""WITH
        cand AS (SELECT DISTINCT conv_id AS item_id, '' AS text FROM conversations),
        refs AS (SELECT conv_id AS item_id, turn AS ref_no, text FROM conversations WHERE role = 'assistant'),
        {cider_tables()}
        SELECT n::BIGINT AS n, gram, df FROM freq WHERE df >= 2""",
    "tfidf_norms": f"""WITH {_CONVERSATIONS}, {cider_tables()}
        SELECT item_id, ref_no, n::BIGINT AS n, round(norm, 6) AS norm FROM norms""",
    "evaluate_end_to_end": f"""WITH
        items AS (
          SELECT doc_id AS item_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS answer FROM documents
        ),
        cand AS (SELECT item_id, array_to_string({tok('answer[1]')}, ' ') AS text FROM items WHERE len(answer) > 0),
        refs AS (
          SELECT item_id, unnest(range(len(answer))) AS ref_no, unnest(answer) AS text FROM items WHERE len(answer) > 0
        ),
        {cider_scores()} {_ITEM_SCORES}""",
}
