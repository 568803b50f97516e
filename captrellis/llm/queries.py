"""Registered queries of the corpus operators. Each applies its operator to a whole table and derives digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.llm.alignment import alignment_counts
from captrellis.llm.bagminhash import near_duplicates
from captrellis.llm.bpe import bpe_decode, bpe_encode
from captrellis.llm.chat_format import format_turns, read_back
from captrellis.llm.compression import fit_quality, score_quality
from captrellis.llm.decontaminate import contamination
from captrellis.llm.licenses import license_scan
from captrellis.llm.packing import pack, token_pieces
from captrellis.llm.pii import find_pii, fit_pii
from captrellis.llm.repetition import repetition_rules
from captrellis.llm.sentences import dedup_sentences
from captrellis.llm.toxicity import fit_toxicity, score_toxicity
from captrellis.llm.twins import ORACLES
from captrellis.llm.whitening import fit_whitening, fixed_point, identity_error, whiten
from captrellis.session import stage

__all__ = ["ORACLES", "QUERIES", "QUALITY_LEAST", "TOKENIZER", "training_labels"]

#: Vocabulary files that the encoding queries read.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
QUALITY_LEAST, TOXIC_LEAST = 0.3, 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def training_labels(spark: SparkSession, sf_dir: str, column: str, parts: int, held_out: int) -> DataFrame:
    """``doc_id, label`` of the rows that a fit may see."""
    return _table(spark, sf_dir, "labels").where(_fold(parts) != held_out).select("doc_id", F.col(column).alias("label"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return bpe_decode(encoded.select("doc_id", "ids"), TOKENIZER).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _scored(docs: DataFrame, parts: int, held_out: int, least: float) -> DataFrame:
    return docs.select(
        "doc_id", (_fold(parts) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(spark, sf_dir, "toxic", 3, 1))
    return _scored(score_toxicity(docs, model), 3, 1, TOXIC_LEAST)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
    return repetition_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs))
    shown = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(shown.format("base")), 256).alias("base_sha256"),
        F.expr(shown.format("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_sentences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nasty = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", nasty), (-7, 1, "assistant", nasty)], turns.schema)
    return read_back(format_turns(turns.unionByName(extra)))


def op9_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, training_labels(spark, sf_dir, "quality", 5, 0))
    return _scored(score_quality(docs, model), 5, 0, QUALITY_LEAST)


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", fixed_point("embedding").alias("x")).where("x IS NOT NULL")
    model = fit_whitening(vectors)
    out = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    if model is None:
        return out.selectExpr("vec_id", "component", "0L AS n", "deviation", "whitened", "0D AS explained", "0D AS identity_error")
    explained = F.lit([float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values])
    return out.select(
        "vec_id",
        (F.col("component") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("component")).alias("explained"),
        F.lit(identity_error(vectors, model)).alias("identity_error"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment_counts(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER).select("doc_id", *names)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stage(token_pieces(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER), "token-pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_toxicity, op3_repetition, op4_pii, op5_licenses, op6_decontaminate, op7_sentences,
        op8_chat_format, op9_compression, op10_bagminhash, op11_whitening, op12_alignment, op13_packing,
    )
}
