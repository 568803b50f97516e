"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, redact, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. Rows with null texts
or keys go through: a null text scores as an empty one, has no duplicates, no benchmark words and no spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.llm.bagminhash import keep_first
from captrellis.llm.bpe import bpe_encode
from captrellis.llm.compression import fit_quality, score_quality
from captrellis.llm.decontaminate import contamination
from captrellis.llm.pii import fit_pii, redact_pii
from captrellis.llm.queries import QUALITY_LEAST, TOKENIZER, training_labels
from captrellis.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = fit_quality(docs, training_labels(spark, sf_dir, "quality", 5, 0))
    return score_quality(docs, model, score="_score").where(F.col("_score") >= QUALITY_LEAST).drop("_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest key; rows without a key all stay."""
    return keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds; ``n_chars`` follows the text."""
    out = redact_pii(docs, fit_pii(docs))
    return out.withColumn("n_chars", F.expr("IF(text IS NULL, n_chars, CAST(length(text) AS BIGINT))")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and the digest of the text that they decode to."""
    return bpe_encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, decoded="decoded").select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]

#: Classifiers, taggers and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
