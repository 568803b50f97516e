"""Image bytes: reading folders of files, and repeatable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of all files below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length", "content")
    )


def blob_name(key: Column | str, extension: Column) -> Column:
    """A name that depends on the row key alone, so a repeated task writes the same file again."""
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(F.sha2(c.cast("string"), 256), extension)


def first_image(images: Column | str) -> Column:
    """First element of an image list, NULL for an empty or missing list."""
    return F.get(F.col(images) if isinstance(images, str) else images, 0)
