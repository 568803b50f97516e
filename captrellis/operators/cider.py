"""CIDEr-D caption scores as one distributed TF-IDF aggregation.

Items of at most :data:`ITEM_BYTES` of text and one candidate are scored in blocks of whole items (:mod:`captrellis.operators.blocks`).

Others, and all items where the frequencies are given, are spread by ``(item, reference)`` while they are still text, over as
many tasks as their bytes ask for (:data:`TASK_BYTES`). The exploded grams inherit that partitioning, so counting them per sentence, and
counting the candidate's grams beside each reference's, needs no further
exchange. Three gram-level steps shuffle: document frequency, the look-up of that
frequency, and the sum per sentence. There no sentence, item or gram is ever collected
into one group.

Input is a :class:`Captions`: the candidates, one row per item, and the pairs,
one row per reference with the candidate beside it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrellis.functions.text import PIECE_CHARS, grams, pieces, token_count, tokens
from captrellis.operators.blocks import block_values
from captrellis.operators.skew import HOT_ROWS, lookup, salted_join
from captrellis.session import shuffles_dropped, stage

#: ``ref_no`` that marks the candidate sentence among an item's sentences.
CANDIDATE = -1

#: Text that one task turns into grams; counting them takes about 300 times as much memory.
TASK_BYTES = 2 * 1024 * 1024

#: Text of an item, with its candidate, up to which it is held in one block.
ITEM_BYTES = 4 * 1024 * 1024


class Captions(NamedTuple):
    """Predicted captions and their references."""

    cands: DataFrame  # item_id, pred
    pairs: DataFrame  # item_id, pred, ref_no (>= 0), ref
    rows: DataFrame | None = None  # item_id, ref_no, text: both without a join; references of other items take no part


class Frequency(NamedTuple):
    """Document frequencies that were counted before, and the size of their corpus."""

    grams: DataFrame  # gram, df, uses
    n_items: Column


def captions_from_arrays(
    items: DataFrame, item_id: str = "item_id", pred: str = "pred", refs: str = "refs"
) -> Captions:
    """One row per item with an array of references; needs no shuffle."""
    cands = items.select(F.col(item_id).alias("item_id"), F.col(pred).alias("pred"), F.col(refs).alias("refs"))
    pairs = cands.select("item_id", "pred", F.posexplode("refs").alias("ref_no", "ref"))

    def sentence(no: Column, text: Column) -> Column:
        return F.struct(no.alias("ref_no"), text.alias("text"))

    mine = F.coalesce(F.transform("refs", lambda t, i: sentence(i, t)), F.array().cast("array<struct<ref_no:int,text:string>>"))
    rows = cands.select("item_id", F.inline(F.concat(F.array(sentence(F.lit(CANDIDATE), F.col("pred"))), mine)).alias("ref_no", "text"))
    return Captions(cands.drop("refs"), pairs, rows)


def captions_from_tables(preds: DataFrame, refs: DataFrame, threshold: int = HOT_ROWS) -> Captions:
    """``preds(item_id, pred)`` and ``refs(item_id, ref_no, ref)``.

    The key, not the position, does the pairing. Items with very many
    references are split over salts. References without a prediction take no part.
    """
    cands = preds.select("item_id", "pred")
    pairs = salted_join(
        refs.select("item_id", F.col("ref_no").cast("int").alias("ref_no"), "ref"),
        cands,
        ["item_id"],
        spread_by=["ref_no"],
        threshold=threshold,
    )
    rows = _rows(cands, refs.where(F.col("item_id").isNotNull()).select("item_id", F.col("ref_no").cast("int").alias("ref_no"), "ref"))
    return Captions(cands, pairs.select("item_id", "pred", "ref_no", "ref"), rows)


def _rows(cands: DataFrame, refs: DataFrame) -> DataFrame:
    mine = cands.select("item_id", F.lit(CANDIDATE).alias("ref_no"), F.col("pred").alias("text"))
    return mine.unionByName(refs.select("item_id", "ref_no", F.col("ref").alias("text")))


def sentence_words(caps: Captions, tokenizer: str = "words", n: int = 4, chars: int = PIECE_CHARS) -> DataFrame:
    """``item_id, ref_no, gap, side, no, words, starts``: tokens of every sentence in pieces.

    References (``side`` 1) stand beside their candidate (``side`` 0); the candidate itself has ``ref_no`` = -1 and
    only ``side`` 1. ``gap`` is the difference of both sentences' bigram counts. ``words`` are the ``starts`` tokens
    of piece ``no`` and up to ``n - 1`` tokens behind it, so that no array grows with a text. Rows are spread by
    ``(item_id, ref_no)``, a unique key, while they are still whole texts.
    """
    nobody = F.lit(None).cast("string")
    sentences = caps.pairs.select(
        "item_id", "ref_no", F.coalesce("pred", F.lit("")).alias("cand"), F.coalesce("ref", F.lit("")).alias("mine")
    ).unionByName(
        caps.cands.select(
            "item_id", F.lit(CANDIDATE).alias("ref_no"), nobody.alias("cand"), F.coalesce("pred", F.lit("")).alias("mine")
        )
    )

    def bigrams(c: str) -> Column:
        return F.greatest(F.coalesce(token_count(c, tokenizer, chars), F.lit(0)) - 1, F.lit(0))

    gap = (bigrams("cand") - bigrams("mine")).alias("gap")
    return _words(_spread(sentences, "mine", "cand"), {"mine": 1, "cand": 0}, tokenizer, n, chars, gap)


def reference_words(refs: DataFrame, tokenizer: str = "words", n: int = 4, chars: int = PIECE_CHARS) -> DataFrame:
    """``item_id, ref_no, side, no, words, starts`` of ``refs(item_id, ref_no, ref)`` alone, as in :func:`sentence_words`."""
    sentences = refs.select("item_id", "ref_no", F.coalesce("ref", F.lit("")).alias("mine"))
    return _words(_spread(sentences, "mine"), {"mine": 1}, tokenizer, n, chars)


def _spread(sentences: DataFrame, *sides: str, task_bytes: int | None = None) -> DataFrame:
    """Sentences by ``(item_id, ref_no)`` over tasks of about ``task_bytes`` of text.

    The bytes are counted first. A number that is given is kept: merged by the size of their texts, partitions would
    grow with the input until their grams fill a task's memory.
    """
    size = sentences.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in sides), F.lit(0))).alias("bytes")).first()["bytes"] or 0
    tasks = max(-(-size // (task_bytes or TASK_BYTES)), sentences.sparkSession.sparkContext.defaultParallelism)
    return sentences.repartition(tasks, "item_id", "ref_no")


def _words(sentences: DataFrame, sides: dict[str, int], tokenizer: str, n: int, chars: int, *extra: Column) -> DataFrame:
    """Pieces of the sentence columns ``sides`` as rows, then their tokens; a NULL sentence has no row."""
    kept = ["item_id", "ref_no", *(["gap"] if extra else [])]
    none = F.array().cast("array<struct<no:int,own:string,ahead:string>>")

    def cut(c: str, side: int) -> Column:
        found = F.coalesce(pieces(c, n, tokenizer, chars), none)
        return F.transform(found, lambda p: F.struct(F.lit(side).alias("side"), p["no"].alias("no"), p["own"].alias("own"), p["ahead"].alias("ahead")))

    rows = sentences.select(*kept[:2], *extra, F.inline(F.concat(*[cut(c, side) for c, side in sides.items()])))
    found = rows.select(*kept, "side", "no", "ahead", tokens("own", tokenizer).alias("own"))
    return found.select(
        *kept, "side", "no", F.concat("own", F.slice(tokens("ahead", tokenizer), 1, n - 1)).alias("words"), F.size("own").alias("starts")
    )


def sentence_grams(words: DataFrame, n: int = 4) -> DataFrame:
    """Long form ``item_id, ref_no, n, gram, gap, tf, tf_cand`` of :func:`sentence_words` made for the same ``n``.

    References carry the candidate's count of the same gram in ``tf_cand``. Every
    sentence also has one row with ``n`` = 0 and no gram, so that empty ones are
    not lost. The rows inherit the partitioning of ``words``: no exchange.
    """
    marker = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram"), F.lit(1).alias("mine")))
    marked = F.when((F.col("side") == 1) & (F.col("no") == 0), marker).otherwise(F.slice(marker, 1, 0))
    long = words.select(
        "item_id", "ref_no", "gap", F.inline(F.concat(marked, grams("words", n, "side", "starts"))).alias("n", "gram", "side")
    )
    return (
        long.groupBy("item_id", "ref_no", "n", "gram")
        .agg(
            F.max("gap").alias("gap"),
            F.count_if(F.col("side") == 1).alias("tf"),
            F.count_if(F.col("side") == 0).alias("tf_cand"),
        )
        .where(F.col("tf") > 0)
    )


def reference_grams(words: DataFrame, n: int = 4) -> DataFrame:
    """``item_id, ref_no, n, gram, tf`` of :func:`reference_words`; no exchange."""
    long = words.select("item_id", "ref_no", F.inline(grams("words", n, 1, "starts")).alias("n", "gram", "side"))
    return long.groupBy("item_id", "ref_no", "n", "gram").agg(F.count("*").alias("tf"))


def document_frequency(words: DataFrame, n: int = 4) -> DataFrame:
    """``gram, df, uses``: items whose references hold the gram, and its occurrences in all sentences.

    Both phases combine map-side, so a gram found in every item costs one row
    per map task.
    """
    per_item = (
        words.where(F.col("side") == 1)
        .select("item_id", "ref_no", F.inline(grams("words", n, 1, "starts")).alias("n", "gram", "mine"))
        # Never NULL; said here so that every use of the table plans the same filter
        # and shares one shuffle instead of counting again.
        .where(F.col("gram").isNotNull())
        .groupBy("gram", "item_id")
        .agg(F.max((F.col("ref_no") != CANDIDATE).cast("int")).alias("in_refs"), F.count("*").alias("rows"))
    )
    return per_item.groupBy("gram").agg(
        F.sum("in_refs").cast("bigint").alias("df"), F.sum("rows").alias("uses")
    )


def _idf(n_items: Column) -> Column:
    df = F.greatest(F.coalesce(F.col("df"), F.lit(0)), F.lit(1)).cast("double")
    return F.ln(n_items.cast("double")) - F.ln(df)


def weighted_grams(
    caps: Captions, n: int = 4, tokenizer: str = "words", threshold: int = HOT_ROWS, frequency: Frequency | None = None
) -> DataFrame:
    """:func:`sentence_grams` with ``idf = ln N - ln max(1, df)``, of the captions' own references or of ``frequency``."""
    words = sentence_words(caps, tokenizer, n)
    if frequency is None:
        frequency = Frequency(document_frequency(words, n), caps.cands.agg(F.count("*")).scalar())
    # A gram of one item weighs the same as one that is not found, so most grams need no look-up. Very frequent
    # ones stay in the table, which spreads their rows.
    needed = frequency.grams.where((F.col("df") >= 2) | (F.col("uses") > threshold))
    found = lookup(
        sentence_grams(words, n), needed, "gram", "df", spread_by=["item_id", "ref_no", "gram"], uses="uses",
        threshold=threshold,
    )
    return found.withColumn("idf", _idf(frequency.n_items))


def _values(
    caps: Captions, n: int, sigma: float, tokenizer: str, norms: bool
) -> tuple[DataFrame, tuple[Captions, Frequency] | None]:
    """:func:`block_values` of the items that fit a block; the others, if there are any, with the frequencies in all items."""
    rows = caps.rows if caps.rows is not None else _rows(caps.cands, caps.pairs)
    sizes = rows.groupBy("item_id").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count_if(F.col("ref_no") == CANDIDATE).alias("cands")
    )
    apart = (F.col("bytes") > ITEM_BYTES) | (F.col("cands") > 1)
    with shuffles_dropped(rows.sparkSession):
        found = sizes.agg(F.sum("bytes"), F.sum("cands"), F.count_if(apart)).first()
    total, n_items, n_large = (x or 0 for x in found)
    if not n_large:
        return block_values(rows, total, n_items, n, sigma, tokenizer, norms)[0], None
    large = stage(sizes.where(apart).select(F.col("item_id").alias("_large")), "large-items")

    def of(table: DataFrame, how: str) -> DataFrame:
        return table.join(large, F.col("item_id").eqNullSafe(F.col("_large")), how)

    big = Captions(of(caps.cands, "left_semi"), of(caps.pairs, "left_semi"))
    others = stage(document_frequency(sentence_words(big, tokenizer, n), n), "large-grams")
    values, sums = block_values(of(rows, "left_anti"), total, n_items, n, sigma, tokenizer, norms, others)
    return values, (big, Frequency(sums, F.lit(n_items)))


def sentence_norms(caps: Captions, n: int = 4, tokenizer: str = "words", threshold: int = HOT_ROWS) -> DataFrame:
    """``item_id, ref_no, n, norm``: L2 norm of each sentence's TF-IDF vector per gram length."""
    values, large = _values(caps, n, 1.0, tokenizer, norms=True)
    norms = values.select("item_id", "ref_no", "n", F.col("value").alias("norm"))
    if large is None:
        return norms
    return norms.unionByName(
        weighted_grams(large[0], n, tokenizer, threshold, large[1])
        .where(F.col("gram").isNotNull())
        .groupBy("item_id", "ref_no", "n")
        .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    )


def score_items(
    caps: Captions, n: int = 4, sigma: float = 6.0, tokenizer: str = "words", threshold: int = HOT_ROWS,
    frequency: Frequency | None = None,
) -> DataFrame:
    """``item_id, n_refs, cider`` for every item.

    ``frequency`` replaces counting the references of ``caps``, for a corpus that is kept in a store
    (:mod:`captrellis.operators.frequency`) and must have been made with the same ``n`` and ``tokenizer``.
    Without it the grams are weighed, length by length, when this is called.

    Per reference and gram length the similarity is the clipped product of the
    two TF-IDF vectors over their norms, damped by the difference in bigram
    counts; it is averaged over lengths and references and scaled by ten.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    if frequency is not None:
        items = _sums(weighted_grams(caps, n, tokenizer, threshold, frequency), n, sigma)
    else:
        values, large = _values(caps, n, sigma, tokenizer, norms=False)
        items = values.groupBy("item_id").agg(F.max("n_refs").alias("n_refs"), F.sum("value").alias("total"))
        if large is not None:
            items = items.unionByName(_sums(weighted_grams(large[0], n, tokenizer, threshold, large[1]), n, sigma))
    checked = F.when(F.col("n_refs") > 0, F.col("n_refs")).otherwise(
        F.raise_error(F.concat(F.lit("item without references: "), F.col("item_id").cast("string"))).cast("bigint")
    )
    return items.withColumn("n_refs", checked).select("item_id", "n_refs", (F.lit(10.0) * F.col("total") / n / F.col("n_refs")).alias("cider"))


def _sums(w: DataFrame, n: int, sigma: float) -> DataFrame:
    """``item_id, n_refs, total`` of :func:`weighted_grams`: similarities added up over references and lengths."""
    squared = F.pow("idf", 2)
    mine = F.col("tf")
    shared = F.least("tf_cand", "tf") * mine

    # One narrow row per sentence and gram length; lengths become columns only per item.
    sentences = w.groupBy("item_id", "ref_no", "n").agg(
        F.max("gap").alias("gap"),
        F.sqrt(F.sum(mine * mine * squared)).alias("norm"),
        F.sum(shared * squared).alias("dot"),
    )
    is_ref = F.col("ref_no") != CANDIDATE
    # The length in the penalty is the number of bigrams, which a unigram score never counts.
    penalty = F.lit(1.0) if n == 1 else F.exp(-F.pow("gap", 2) / F.lit(2.0 * sigma * sigma))
    sim = F.when(is_ref & (F.col("norm") > 0), F.col("dot") * penalty / F.col("norm")).otherwise(0.0)
    items = sentences.groupBy("item_id").agg(
        F.count_if(is_ref & (F.col("n") == 0)).alias("n_refs"),
        *[F.max(F.when(~is_ref & (F.col("n") == k), F.col("norm"))).alias(f"norm{k}") for k in range(1, n + 1)],
        *[F.sum(F.when(F.col("n") == k, sim).otherwise(0.0)).alias(f"sim{k}") for k in range(1, n + 1)],
    )
    total = sum(
        (F.when(F.col(f"norm{k}") > 0, F.col(f"sim{k}") / F.col(f"norm{k}")).otherwise(0.0) for k in range(1, n + 1)),
        F.lit(0.0),
    )
    return items.select("item_id", "n_refs", total.alias("total"))


def score_corpus(scores: DataFrame) -> DataFrame:
    """``items, cider``: mean over the items of :func:`score_items`."""
    return scores.agg(F.count("*").alias("items"), F.avg("cider").alias("cider"))
