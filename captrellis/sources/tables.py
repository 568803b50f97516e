"""Reading, checking and writing corpus tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_table(spark: SparkSession, path: str, split: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A prepared Parquet table, optionally one split and some columns of it.

    With ``split`` as partition column only that folder is read.
    """
    df = spark.read.parquet(path)
    if split is not None:
        require_columns(df, ["split"])
        df = df.where(F.col("split") == split).drop("split")
    if columns is not None:
        columns = list(columns)
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None) -> None:
    """Save prepared metadata; folders are created as needed."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail before any job runs if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found. Available columns: {df.columns}")


def require_rows(df: DataFrame, name: str = "table") -> None:
    """Fail if there is nothing to do."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")


def extended(schema: StructType, *names: str) -> StructType:
    """A copy of ``schema`` with nullable string columns added."""
    out = StructType(list(schema.fields))
    for name in names:
        out = out.add(name, StringType(), True)
    return out


def column_audit(df: DataFrame, name: str, required: Iterable[str]) -> DataFrame:
    """``table_name, column_name, present, n_rows, n_null`` for every required column, in one pass."""
    required = list(required)
    present = [c for c in required if c in df.columns]
    counts = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(c in present).alias("present"),
                (F.col(f"null_{c}") if c in present else F.lit(None).cast("bigint")).alias("n_null"),
            )
            for c in required
        ]
    )
    return counts.select(F.lit(name).alias("table_name"), "n_rows", F.inline(rows))
