"""Token ids, fixed-size batches, padding, label masks, trimming and decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from captrellis.operators.ordering import RANGE_ROWS, number_by_key, number_shuffled, numbered
from captrellis.operators.skew import HOT_ROWS, lookup
from captrellis.session import stage

IGNORED_LABEL = -100

#: Largest vocabulary that is broadcast, measured in bytes of its words and ids.
BROADCAST_BYTES = 64 * 1024 * 1024

# Special tokens in front of every vocabulary; the id is the position.
SPECIAL_TOKENS = ["<pad>", "<unk>", "<image>"]
PAD_ID, UNK_ID, IMAGE_ID = 0, 1, 2


def special_id(token: str, ids: Sequence[int] = (PAD_ID, UNK_ID, IMAGE_ID), tokens: Sequence[str] = tuple(SPECIAL_TOKENS)) -> int:
    """Id of a special token by its place in the list."""
    if token not in tokens:
        raise ValueError(f"{token!r} is not a special token; known: {list(tokens)}")
    return ids[list(tokens).index(token)]


def build_vocab(df: DataFrame, tokens: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``token, id, is_special, uses``: words ranked by (count descending, word), after the specials.

    Special tokens among the words are not ranked again.
    Counting combines map-side. The counts, one narrow row per distinct word, are stored and numbered
    in ranges of equal size, however many words share a count or a beginning.
    """
    words = (
        df.select(F.explode(tokens).alias("token"))
        .where(F.col("token").isNotNull() & ~F.col("token").isin(*SPECIAL_TOKENS))
        .groupBy("token")
        .agg(F.count("*").alias("uses"))
    )
    ranked = numbered(stage(words, "word-counts"), [F.col("uses").desc(), F.col("token")], "_rank", range_rows=range_rows)
    ids = ranked.select(
        "token",
        (F.col("_rank") - 1 + len(SPECIAL_TOKENS)).cast("bigint").alias("id"),
        F.lit(False).alias("is_special"),
        "uses",
    )
    specials = df.sparkSession.createDataFrame(
        [(t, i, True, 0) for i, t in enumerate(SPECIAL_TOKENS)],
        "token string, id bigint, is_special boolean, uses bigint",
    )
    return specials.unionByName(ids)


def _bytes(table: DataFrame, key: str, value: str) -> int:
    """Size of a vocabulary in memory."""
    return table.agg(F.sum(F.octet_length(F.concat_ws("", key, value)) + 32).alias("bytes")).first()["bytes"] or 0


def _find(
    long: DataFrame, table: DataFrame, key: str, value: str, spread_by: list[str], broadcast_bytes: int, threshold: int
) -> DataFrame:
    """Left join of ``long`` with ``table``: broadcast up to ``broadcast_bytes``, else shuffled.

    The shuffled way spreads hot words evenly (``lookup``), for which it counts
    the words of ``long`` first.
    """
    if _bytes(table, key, value) <= broadcast_bytes:
        return long.join(F.broadcast(table), key, "left")
    uses = long.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_uses"))
    return lookup(long, table.join(uses, key), key, value, spread_by, uses="_uses", threshold=threshold)


def _first_places() -> Column:
    """How often a group's first position occurs: more than once if keys or vocabulary entries repeat."""
    return F.count_if(F.coalesce("_pos", F.lit(0)) == 0)


def _if_single(value: Column) -> Column:
    return F.when(F.col("_rows") > 1, F.raise_error(F.lit("repeated key, or repeated vocabulary entry"))).otherwise(value)


def encode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    tokens: Column | str,
    ids: str = "ids",
    unk_id: int = UNK_ID,
    broadcast_bytes: int = BROADCAST_BYTES,
    threshold: int = HOT_ROWS,
) -> DataFrame:
    """``keys, ids``: token arrays as id arrays in the same order; unknown tokens give ``unk_id``.

    ``vocab`` should be a stored table: its size is checked first. Up to ``broadcast_bytes`` it goes to the tasks,
    which look up the tokens of a batch at once, and nothing is exchanged but the keys, which must not repeat. A
    larger one is joined to the tokens in long form (see ``_find``). ``tokens`` is a column or an expression over
    ``df``; in the long form rows are spread by ``keys`` before it is evaluated, so an expression over text moves the text.
    """
    keys = list(keys)
    table = vocab.select(F.col("token").alias("_token"), F.col("id").cast("bigint").alias("_id"))
    if _bytes(table, "_token", "_id") <= broadcast_bytes:
        return _encode_in_tasks(df, table, keys, tokens, ids, unk_id)
    long = df.repartition(*keys).select(*keys, F.posexplode_outer(tokens).alias("_pos", "_token"))
    found = _find(long, table, "_token", "_id", [*keys, "_pos"], broadcast_bytes, threshold)
    known = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(unk_id)).alias("id")))
    return (
        found.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(known)).alias("_pairs"), _first_places().alias("_rows"))
        .select(*keys, _if_single(F.transform("_pairs", lambda p: p["id"])).alias(ids))
    )


def _encode_in_tasks(df: DataFrame, table: DataFrame, keys: list[str], tokens: Column | str, ids: str, unk_id: int) -> DataFrame:
    """:func:`encode` with a vocabulary that every task holds; a NULL array gives no ids."""
    rows = df.select(*keys, (F.col(tokens) if isinstance(tokens, str) else tokens).cast("array<string>").alias(ids))
    known = table.where("_token IS NOT NULL").toArrow().combine_chunks()
    if pc.count_distinct(known["_token"]).as_py() != known.num_rows or not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("repeated key, or repeated vocabulary entry")
    words = df.sparkSession.sparkContext.broadcast(
        (pa.array(known["_token"].to_pylist(), pa.string()), known["_id"].fill_null(unk_id).to_numpy())
    )
    schema = StructType([*(rows.schema[k] for k in keys)]).add(ids, ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, numbers = words.value
        # The last number is that of a token that is not found.
        numbers = np.append(numbers, unk_id)
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten()
            place = pc.fill_null(pc.index_in(flat.cast(pa.string()), value_set=texts, skip_nulls=True), len(texts))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[place.to_numpy(zero_copy_only=False)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), out], [*keys, ids])

    return rows.mapInArrow(run, schema)


def decode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    ids: str = "ids",
    text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    threshold: int = HOT_ROWS,
) -> DataFrame:
    """``keys, text``: id arrays as words joined by one space, special tokens left out."""
    keys = list(keys)
    long = df.repartition(*keys).select(*keys, F.posexplode_outer(ids).alias("_pos", "_id")).withColumn("_key", F.col("_id").cast("string"))
    words = vocab.where(~F.col("is_special")).select(F.col("id").cast("string").alias("_key"), F.col("token").alias("_token"))
    found = _find(long, words, "_key", "_token", [*keys, "_pos"], broadcast_bytes, threshold)
    word = F.when(F.col("_token").isNotNull(), F.struct("_pos", F.col("_token").alias("token")))
    return (
        found.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(word)).alias("_pairs"), _first_places().alias("_rows"))
        .select(*keys, _if_single(F.array_join(F.transform("_pairs", lambda p: p["token"]), " ")).alias(text))
    )


def batched(
    df: DataFrame, key: str, batch_size: int, order: str = "key", seed: int | str = 42
) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos``: fixed-size batches in row order, the last one may be short.

    ``order`` is ``key`` (ascending unique numeric key) or ``shuffled`` (seeded).
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if order == "key":
        numbered = number_by_key(df, key, rn="_rn")
    elif order == "shuffled":
        numbered = number_shuffled(df, [key], seed, rn="_rn")
    else:
        raise ValueError("order is 'key' or 'shuffled'")
    zero_based = F.col("_rn") - 1
    return (
        numbered.withColumn("batch_id", F.floor(zero_based / batch_size))
        .withColumn("batch_pos", F.pmod(zero_based, F.lit(batch_size)))
        .drop("_rn")
    )


def padded(df: DataFrame, ids: str = "ids", pad_id: int = PAD_ID, side: str = "right") -> DataFrame:
    """Turn ``ids`` into ``input_ids`` and ``attention_mask`` of equal length within a batch.

    Needs ``batch_id`` from :func:`batched`; a batch never has more rows than its size.
    """
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    lack = F.col("_longest") - F.size(ids)

    def joined(body: Column, filler: int) -> Column:
        fill = F.array_repeat(F.lit(filler), lack)
        return F.concat(body, fill) if side == "right" else F.concat(fill, body)

    return (
        df.withColumn("_longest", longest)
        .withColumn("input_ids", joined(F.col(ids), pad_id))
        .withColumn("attention_mask", joined(F.array_repeat(F.lit(1), F.size(ids)), 0))
        .drop("_longest", ids)
    )


def label_mask(input_ids: Column | str, pad_id: int = PAD_ID, image_id: int = IMAGE_ID) -> Column:
    """Labels: the ids with padding and image tokens set to -100."""
    return F.transform(
        input_ids, lambda x: F.when(x.isin(pad_id, image_id), F.lit(IGNORED_LABEL)).otherwise(x)
    )


def trim_prompt(output_ids: Column | str, input_ids: Column | str) -> Column:
    """Generated ids without the prompt in front of them."""
    out = F.col(output_ids) if isinstance(output_ids, str) else output_ids
    return F.slice(out, F.size(input_ids) + 1, F.greatest(F.size(out) - F.size(input_ids), F.lit(0)))
