"""Quality gate over asset tables: status filter, header checks, rejects and the drop report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from captrellis.functions.images import probe, reject_reason

REASONS = ("corrupted", "small_or_mode", "high_res")


def succeeded(path: str = "image_path", status: str = "status") -> Column:
    """Rows whose asset was stored."""
    return F.col(path).isNotNull() & F.coalesce(F.col(status) == "success", F.lit(False))


def keep_succeeded(df: DataFrame, path: str = "image_path", status: str = "status") -> DataFrame:
    return df.where(succeeded(path, status))


def gated(df: DataFrame, content: str = "content", max_pixels: int | None = None) -> DataFrame:
    """Add ``header`` and ``reject_reason``; the bytes stay where they are, nothing shuffles."""
    return df.withColumn("header", probe(content)).withColumn(
        "reject_reason", reject_reason(F.col("header"), max_pixels)
    )


def without_rejects(df: DataFrame, rejects: list[DataFrame], key: str) -> DataFrame:
    """Rows of ``df`` whose key is in none of the reject tables.

    Repeated reject ids shrink to one before the shuffle, and NULL ids reject nobody.
    """
    ids = rejects[0].select(key)
    for other in rejects[1:]:
        ids = ids.union(other.select(key))
    return df.join(ids.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def _counts(path: str, status: str) -> list[Column]:
    stored = succeeded(path, status)
    final = stored & F.col("reject_reason").isNull()
    return [
        *[F.count_if(stored & (F.col("reject_reason") == r)).alias(r) for r in REASONS],
        (F.count("*") - F.count_if(final)).alias("total_removed"),
        F.count_if(final).alias("final_size"),
    ]


def drop_report(df: DataFrame, path: str = "image_path", status: str = "status") -> DataFrame:
    """One row of counts. ``total_removed`` also counts rows that were never stored."""
    return df.agg(*_counts(path, status))


def observe_drops(df: DataFrame, path: str = "image_path", status: str = "status") -> tuple[DataFrame, Observation]:
    """The same counts collected while ``df`` is written, without a second pass."""
    seen = Observation()
    return df.observe(seen, *_counts(path, status)), seen


def status_report(df: DataFrame, status: str = "download_status") -> DataFrame:
    """Rows per kind of status; the message after the colon is left out."""
    kind = F.regexp_extract(F.col(status), "^[a-z_]+", 0)
    return df.groupBy(kind.alias("status")).agg(F.count("*").alias("rows"))
