"""Quality classifier by compression.

One zstandard dictionary is trained on pieces of good and one on pieces of bad labelled texts, both of one size. A
text is compressed with both, in pieces so that a dictionary counts in long texts too. How much smaller the good one
makes it, over the text's length and over its square root, is calibrated to a probability by a logistic fit on
labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches, share_of, slices, worker_cache
from captrellis.session import stage

#: Labelled rows per class that the fit reads, and pieces of their texts per class that a dictionary is trained on.
SAMPLE_ROWS = 2_000
SAMPLE_PIECES = 8_192
DICTIONARY_BYTES = 64 * 1024
#: Bytes of text per byte of dictionary, where there is less text than a dictionary of full size needs.
TEXT_PER_BYTE = 4
PIECE_BYTES = 2048
LEVEL = 3


@dataclass
class CompressionModel:
    """Dictionaries and calibration; ``weights`` is None if a class has no labelled text, then ``prior`` is the score."""

    good: bytes
    bad: bytes
    weights: np.ndarray | None
    prior: float

    def compressors(self) -> list[zstd.ZstdCompressor]:
        held = worker_cache("compressors")
        key = (hash(self.good), hash(self.bad))
        if key not in held:
            held[key] = [_compressor(self.good), _compressor(self.bad)]
        return held[key]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        z = measures(texts, *self.compressors()) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    data = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_FULLDICT)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionaries(good: list[bytes], bad: list[bytes]) -> list[bytes]:
    """A dictionary of each class, trained on all its pieces. Both have the size that the class with less text allows."""
    text = min(sum(map(len, good)), sum(map(len, bad)))
    size = max(1024, min(DICTIONARY_BYTES, text // TEXT_PER_BYTE))
    # The trainer wants a few samples of some length; repeating them changes nothing that it looks for.
    return [zstd.train_dictionary(size, pieces * max(1, -(-64 // len(pieces))), k=64, d=8).as_bytes() for pieces in (good, bad)]


def measures(texts: list[bytes], good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> np.ndarray:
    """Per text: 1, the size difference over the text's length, and over the square root of its length."""
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        pieces = [text[at : at + PIECE_BYTES] for at in range(0, len(text), PIECE_BYTES)]
        difference = sum(len(bad.compress(p)) for p in pieces) - sum(len(good.compress(p)) for p in pieces)
        n = max(1, len(text))
        out[i] = 1, 20 * difference / n, difference / n**0.5
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a weighted ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, pieces: int = SAMPLE_PIECES) -> CompressionModel:
    """Fit on at most about ``rows`` labelled documents of each class; ``labels`` has ``doc_id, label``.

    Which rows are chosen depends on a hash of their ids only. Half of them, by another hash, build the dictionaries
    from at most about ``pieces`` pieces of their whole texts, the others the calibration. Null labels and null or
    empty texts are left out; a row that is repeated, in either table, counts as often as it occurs. Without texts of
    both classes in both halves the score is the share of label 1.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
    sample = [known.where(F.col("label") == v) for v in (0, 1)]
    sample = [own.where(share_of(own, "doc_id", rows)).select("doc_id", "label") for own in sample]
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")
    # The sample is bounded by rows, so it is the broadcast side.
    read = docs.select("doc_id", "text").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id").where("length(text) > 0")
    read = stage(read.select("doc_id", "text", "label", half), "quality-sample")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = (n_good + 1) / (n_good + n_bad + 2)
    cut = f"transform(sequence(0, CAST((length(text) - 1) DIV {PIECE_BYTES} AS INT)), i -> substring(text, i * {PIECE_BYTES} + 1, {PIECE_BYTES}))"
    cut = read.where("half = 0").select("doc_id", "label", F.posexplode(F.expr(cut)).alias("place", "piece"))
    held = []
    for v in (1, 0):
        own = cut.where(F.col("label") == v)
        chosen = own.where(share_of(own, F.struct("doc_id", "place"), pieces)).orderBy("doc_id", "place", "piece")
        held.append([r["piece"].encode() for r in chosen.select("piece").collect()])
    if not all(held):
        return CompressionModel(b"", b"", None, prior)
    model = CompressionModel(*build_dictionaries(*held), None, prior)
    bounded_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measures([t.encode() for t in part.column("text").to_pylist()], *model.compressors())
                yield pa.RecordBatch.from_arrays([part.column("label"), *map(pa.array, found.T[1:])], ["label", "a", "b"])

    # Texts stay in the tasks: only three numbers of each come back.
    seen = read.where("half = 1").select("text", F.col("label").cast("int").alias("label")).mapInArrow(measure, "label int, a double, b double")
    seen = np.array(sorted((r.label, 1.0, r.a, r.b) for r in seen.collect())).reshape(-1, 4)
    y, x = seen[:, 0], seen[:, 1:]
    if len(set(y)) < 2:
        return CompressionModel(b"", b"", None, prior)
    # An empty text tells nothing: it gets the share of label 1.
    y, x = np.concatenate([y, [1, 0]]), np.vstack([x, [[1, 0, 0]] * 2])
    # Classes were sampled to equal sizes: weight them back, so that the score is a probability of this corpus.
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    model.weights = fit_logistic(x, y, weight)
    return model


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` plus ``score``: the probability of label 1. Null and empty texts get the score of an empty text."""
    if score in docs.columns:
        raise ValueError(f"column {score} exists already")
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = [(t or "").encode() for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts))], [*part.schema.names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(apply, f"{fields}, `{score}` double")
