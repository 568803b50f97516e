"""Helpers of the corpus operators: task-side caches, bounded slices, word tables, samples.

Texts reach Python tasks as Arrow arrays. Words are cut by Arrow's own splitter on the bytes of a whole slice,
so a slice costs a few library calls instead of one Python call per word.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1024 * 1024
#: Bytes and rows that Spark puts into one Arrow batch for a Python task.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 4096

#: ``A-Z`` become lower case; ASCII that is neither letter nor digit becomes a blank; other bytes stay.
LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows for this session, so that long texts cannot pile up in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, also when task code travels by value."""
    module = sys.modules.setdefault("captrellis_worker_cache", types.ModuleType("captrellis_worker_cache"))
    return module.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` holding at most ``limit`` text bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def words(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all texts in order, row borders in them, and the dictionary of the codes.

    Words are runs between ASCII white space, after the byte ``table`` if one is given. Null texts have none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    borders = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = held[int(borders[0]) : int(borders[-1])].to_pybytes() if held is not None and len(texts) else b""
    if table is not None:
        data = data.translate(table)
    moved = pa.py_buffer(np.ascontiguousarray(borders - borders[0]).tobytes())
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, moved, pa.py_buffer(data)])
    parts = pc.ascii_split_whitespace(texts)
    ends = parts.offsets.to_numpy()
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    starts = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[ends]
    coded = flat.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts.astype(np.int64), coded.dictionary


def hash_words(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each dictionary word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all ``size``-word windows that stay inside a row, and the windows' 64-bit hashes."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashed = np.zeros(n, np.uint64)
    for k in range(size):
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n] + np.uint64(k + 1))
    inside = np.ones(n + 1, bool)
    for k in range(1, size):  # a window that starts k words before a row's first word crosses the border
        crossing = starts[(starts >= k) & (starts - k <= n)] - k
        inside[crossing] = False
    inside = inside[:n]
    # Borders of empty rows coincide with those of their neighbours, so the test above covers them too.
    return np.flatnonzero(inside), hashed[inside]


def share_of(df: DataFrame, key: str | Column, bound: int) -> Column:
    """A filter that keeps about ``bound`` rows, chosen by a hash of ``key``; all rows if there are fewer.

    The choice depends on the key alone, never on partitions, so every attempt of a task repeats it.
    """
    n = df.count()
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(key) if isinstance(key, str) else key), F.lit(1 << 30))
    return F.lit(True) if n <= bound else spread < int((1 << 30) * bound / n)
