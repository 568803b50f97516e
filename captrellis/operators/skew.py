"""Joins that stay balanced when a few keys own a large share of the rows.

The hot set is the top :data:`MAX_HOT` keys by row count. Its size is therefore
bounded whatever the data, so broadcasting it is safe; a key outside it holds at
most ``1 / MAX_HOT`` of all rows, and adaptive execution splits what that leaves. The hot set steers *where* rows go,
never *which* rows are kept: results are the same with any threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT = 65_536
#: Rows of one key that a single task may comfortably hold.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], threshold: int = HOT_ROWS) -> DataFrame:
    """``keys, salts`` for keys with more than ``threshold`` rows; at most ``MAX_HOT`` rows."""
    return _hot(df.groupBy(*keys).agg(F.count("*").alias("rows")), keys, threshold)


def _hot(counts: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    return (
        counts.where(F.col("rows") > threshold)
        .orderBy(F.col("rows").desc())
        .limit(MAX_HOT)
        .select(*keys, F.ceil(F.col("rows") / threshold).cast("int").alias("_salts"))
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    threshold: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of a possibly skewed ``big`` with a ``small`` that has few rows per key.

    Rows of a hot key in ``big`` are spread over several salts by a hash of
    ``spread_by``; the rows of ``small`` with that key are repeated once per
    salt. Cold keys have one salt. ``how`` is ``inner`` or ``left``.

    ``counts`` (``keys`` plus ``rows``) saves the counting pass when the caller
    already knows the row count per key.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    keys = list(keys)
    hot = _hot(counts, keys, threshold) if counts is not None else hot_keys(big, keys, threshold)
    hot = F.broadcast(hot)  # at most MAX_HOT rows
    left = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(
            F.col("_salts").isNotNull(),
            F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col("_salts")).cast("int"),
        ).otherwise(F.lit(0)),
    ).drop("_salts")
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup(
    big: DataFrame,
    table: DataFrame,
    key: str,
    value: str,
    spread_by: Sequence[str],
    uses: str,
    threshold: int = HOT_ROWS,
) -> DataFrame:
    """Add ``value`` from ``table`` (one row per ``key``, a string) to every row of ``big``.

    ``table`` carries in ``uses`` about how many rows of ``big`` need each key. The
    hottest keys, at most ``MAX_HOT``, are answered from a broadcast; their rows
    are then scattered evenly through the shuffle that serves all other keys, and
    so are rows without a key. Keys missing from ``table`` give NULL.
    """
    hot = F.broadcast(
        table.where(F.col(uses) > threshold)
        .orderBy(F.col(uses).desc())
        .limit(MAX_HOT)
        .select(F.col(key), F.col(value).alias("_hot_value"))
    )
    # A NUL in front cannot occur in a real key, so a scattered row finds no match.
    scattered = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in spread_by]).cast("string"))
    # Filtering on ``uses`` here too keeps both branches on one shuffle of ``table``
    # (exchange reuse); keys nobody uses would not be found anyway.
    # The merge hint rules out a broadcast by size estimate: exploded tables are far
    # larger than the files they are estimated from.
    cold = (
        table.where(F.col(uses) > 0)
        .select(F.col(key).alias("_probe"), F.col(value).alias("_cold_value"))
        .hint("merge")
    )
    return (
        big.join(hot, key, "left")
        .withColumn(
            "_probe", F.when(F.col("_hot_value").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(scattered)
        )
        .join(cold, "_probe", "left")
        .withColumn(value, F.coalesce("_hot_value", "_cold_value"))
        .drop("_hot_value", "_cold_value", "_probe")
    )


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per key in ``order``, numbered in ``_no`` from 1.

    Spark cuts each map task's rows to ``k`` per key before the shuffle
    (window group limit), so a hot key arrives as ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= k)
