"""Seeded shuffles, exact samples and splits, and dense row numbers without a global sort task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captrellis.functions.hashing import order_key, pick
from captrellis.session import stage

#: Hex digits of the hash that one step towards a cut looks at: at most 16**4 = 65,536 counts.
STEP_DIGITS = 4
#: Rows of one range, which one task sorts and numbers.
RANGE_ROWS = 1_000_000
#: Counts whose prefix sums one task takes.
COUNTS_IN_TASK = 4096


def shuffled(df: DataFrame, keys: Sequence[str], seed: int | str) -> DataFrame:
    """Rows in a repeatable pseudo-random order (range-partitioned sort)."""
    return df.orderBy(order_key(seed, *keys), *keys)


def _before(counts: DataFrame, place: str) -> DataFrame:
    """``place, _before``: rows in front of each place, from ``place, _rows``; places are numbers from 0.

    Prefix sums on two levels: inside groups of :data:`COUNTS_IN_TASK` places, and over the groups.
    """
    grouped = counts.withColumn("_group", F.floor(F.col(place) / COUNTS_IN_TASK))
    groups = grouped.groupBy("_group").agg(F.sum("_rows").alias("_all"))
    earlier = groups.select("_group", (F.sum("_all").over(Window.orderBy("_group")) - F.col("_all")).alias("_earlier"))
    inside = F.sum("_rows").over(Window.partitionBy("_group").orderBy(place)) - F.col("_rows")
    return grouped.withColumn("_inside", inside).join(F.broadcast(earlier), "_group").select(
        place, (F.col("_inside") + F.col("_earlier")).alias("_before")
    )


def numbered(
    df: DataFrame, order: Sequence[Column | str], rn: str = "rn", total: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Dense 1-based position of every row in ``order``, which must tell all rows apart.

    Spark deals the rows to ranges by a sample of the order; their number follows the row count. A task sorts its
    range and writes it with the places inside; the counts of the ranges, one narrow row each, then turn places into
    positions. Positions do not depend on where the borders fall. ``df`` is read three times (count, sample, rows):
    pass a stored table. ``total`` names an optional column with the row count.
    """
    rows = df.count()
    ranges = max(-(-rows // range_rows), df.sparkSession.sparkContext.defaultParallelism)
    # The id is the number of the task in its upper bits and the place among the task's rows in the lower 33.
    placed = stage(
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range: a millionth of the rows.
    out = placed.join(F.broadcast(_before(counts, "_range")), "_range").withColumn(rn, place + F.col("_before") + 1)
    if total:
        out = out.withColumn(total, F.lit(rows).cast("bigint"))
    return out.drop("_at", "_range", "_before")


def number_shuffled(
    df: DataFrame, keys: Sequence[str], seed: int | str, rn: str = "rn", total: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Dense 1-based position of every row in the seeded order; ``keys`` must be unique."""
    return numbered(df.withColumn("_h", order_key(seed, *keys)), ["_h", *keys], rn, total, range_rows).drop("_h")


def number_by_key(df: DataFrame, key: str, rn: str = "rn", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Dense 1-based position of every row in ascending order of a unique ``key``; a NULL key comes first."""
    return numbered(df, [key], rn, range_rows=range_rows)


def _cut_at(df: DataFrame, keys: Sequence[str], seed: int | str, n: int, range_rows: int = RANGE_ROWS) -> str | None:
    """The order key that exactly the first ``n`` rows do not exceed; None if there are fewer rows.

    A radix search: each step counts the rows by the next digits of the key and goes on in the one place that holds
    row ``n``, until that place has at most ``range_rows`` rows, whose keys are then sorted.
    """
    h = df.select(order_key(seed, *keys).alias("_h"))
    prefix, wanted = "", n
    while True:
        counts = (
            h.where(F.col("_h").startswith(prefix))
            .groupBy(F.substring("_h", len(prefix) + 1, STEP_DIGITS).alias("_digits"))
            .agg(F.count("*").alias("_rows"))
        )
        upto = F.sum("_rows").over(Window.orderBy("_digits"))  # at most 65,536 rows
        edge = counts.withColumn("_upto", upto).where(F.col("_upto") >= wanted).orderBy("_digits").limit(1).first()
        if edge is None:
            return None
        prefix, wanted = prefix + edge["_digits"], wanted - (edge["_upto"] - edge["_rows"])
        if edge["_rows"] <= range_rows or not edge["_digits"]:
            break
    inside = (
        h.where(F.col("_h").startswith(prefix))
        .groupBy("_h")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(Window.orderBy("_h")))
        .where(F.col("_upto") >= wanted)
        .orderBy("_h")
        .limit(1)
        .first()
    )
    if inside["_upto"] != wanted:
        raise ValueError(f"{list(keys)} must identify every row for an exact cut")
    return inside["_h"]


def hash_cut(
    df: DataFrame, keys: Sequence[str], fraction: float, seed: int | str, rounding: str
) -> tuple[str | None, int, int]:
    """``(cut, n, total)``: rows whose order key is at most ``cut`` are exactly the first ``n``.

    Only key hashes are counted (:func:`_cut_at`). Selecting rows afterwards is a plain filter.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    if rounding not in ("floor", "ceil"):
        raise ValueError("rounding is 'floor' or 'ceil'")
    total = df.count()
    n = getattr(math, rounding)(float(fraction) * total)
    return (_cut_at(df, keys, seed, n) if n else None), n, total


def _first_part(keys: Sequence[str], seed: int | str, cut: str | None) -> Column:
    return F.lit(False) if cut is None else order_key(seed, *keys) <= F.lit(cut)


def exact_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int | str) -> DataFrame:
    """Exactly ``floor(fraction * rows)`` rows, the first ones of the seeded order."""
    cut, _, _ = hash_cut(df, keys, fraction, seed, "floor")
    return df.where(_first_part(keys, seed, cut))


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.1, seed: int | str = 42, column: str = "split"
) -> DataFrame:
    """Mark exactly ``ceil(test_size * rows)`` rows ``test`` and all others ``train``."""
    cut, _, _ = hash_cut(df, keys, test_size, seed, "ceil")
    return df.withColumn(column, F.when(_first_part(keys, seed, cut), "test").otherwise("train"))


def row_at(df: DataFrame, keys: Sequence[str], position: int, seed: int | str) -> DataFrame:
    """The row at a 0-based position of the seeded order, or none: a filter over the scan, no rows are numbered."""
    if position < 0:
        raise ValueError("position must not be negative")
    cut = _cut_at(df, keys, seed, position + 1)
    return df.where(F.lit(False) if cut is None else order_key(seed, *keys) == F.lit(cut))


def few_shot_draws(
    df: DataFrame, key: str, k: int, seed: int | str, exclude_self: bool = False, columns: Sequence[str] = ()
) -> DataFrame:
    """``k`` rows of ``df``, drawn with replacement, for every row of ``df``.

    Returns ``key, shot, shot_<key>, shot_<column>...`` in long form. A draw
    names a row number, so the look-up is an equi-join on a dense unique key.
    A row may draw itself unless ``exclude_self``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    numbered = number_shuffled(df.select(key, *columns), [key], seed, rn="_rn", total="_n")
    asked = numbered.select(key, "_rn", "_n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("shot"))
    others = F.col("_n") - 1
    if exclude_self:
        # Skip over the row's own number; a table of one row has nobody else to draw.
        draw = F.when(others > 0, pick(F.greatest(others, F.lit(1)), seed, key, "shot") + 1)
        draw = draw + F.when(draw >= F.col("_rn"), 1).otherwise(0)
    else:
        draw = pick(F.col("_n"), seed, key, "shot") + 1
    shots = numbered.select(
        F.col("_rn").alias("_draw"),
        F.col(key).alias(f"shot_{key}"),
        *[F.col(c).alias(f"shot_{c}") for c in columns],
    )
    return asked.withColumn("_draw", draw).drop("_rn", "_n").join(shots, "_draw").drop("_draw")
