"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark texts are cut into windows of 13 words; a shorter one is a single window. Blocks of bounded size are
broadcast, and a worker builds the sorted window hashes of one block as flat arrays. A task looks at every word
window of its documents, compares hits byte by byte, and gives back the hit words and the items found. Documents
are never shuffled; with several blocks they are written between two of them, so that a worker holds one block.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import LOWER_WORDS, SLICE_BYTES, bounded_batches, hash_words, slices, windows, words, worker_cache
from captrellis.session import stage

WINDOW = 13
#: Benchmark text bytes per broadcast block: at most half as many words, each 28 bytes in a worker's arrays.
#: More text means more blocks, each against all documents.
BLOCK_BYTES = 16 * 1024 * 1024


class WindowSet:
    """Windows of a block of items: sorted hashes, and where the words of each stand in the block's plain text."""

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW) -> None:
        self.names = [item for item, _ in items]
        plain, known, tables = bytearray(), [], defaultdict(list)
        table = pa.RecordBatch.from_pydict({"item": pa.array(range(len(items)), pa.int32()), "text": pa.array([t for _, t in items], pa.string())})
        for part in slices(table, limit=SLICE_BYTES):
            codes, starts, dictionary = words(part.column("text"), LOWER_WORDS)
            if not len(codes):
                continue
            found, hashed = [w.encode() for w in dictionary.to_pylist()], hash_words(dictionary)
            known = [np.unique(np.concatenate([*known, hashed]))]
            lengths = np.array([len(w) for w in found])[codes]
            ends = len(plain) + np.cumsum(lengths + 1) - 1
            begins = ends - lengths
            plain += b" ".join([found[c] for c in codes.tolist()]) + b" "
            counts = np.diff(starts)
            rows = np.repeat(part.column("item").to_numpy(), counts)
            for length in np.unique(np.minimum(counts[counts > 0], size)).tolist():
                at, window = windows(hashed[codes], starts, length)
                if length < size:  # only items of just so many words
                    whole = np.repeat(counts == length, counts)[at]
                    at, window = at[whole], window[whole]
                tables[length].append((window, begins[at].astype(np.int32), ends[at + length - 1].astype(np.int32), rows[at]))
        self.plain, self.known = bytes(plain), known[0] if known else np.empty(0, np.uint64)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for length in list(tables):
            columns = [np.concatenate(c) for c in zip(*tables.pop(length))]
            order = np.argsort(columns[0], kind="stable")
            self.tables[length] = tuple(c[order] for c in columns)

    @property
    def nbytes(self) -> int:
        """Bytes of the built arrays and the plain text."""
        return len(self.plain) + self.known.nbytes + sum(c.nbytes for t in self.tables.values() for c in t)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Row borders in words, hit flag per word, items per text."""
        codes, starts, dictionary = words(texts, LOWER_WORDS)
        hashed = hash_words(dictionary)
        place = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        known = self.known[place] == hashed if len(self.known) else np.zeros(len(hashed), bool)
        hit, items = np.zeros(len(codes) + 1, np.int64), [set() for _ in range(len(texts))]
        # Only runs of known words can hold a window: cut the texts there.
        edges = np.flatnonzero(known[codes])
        if len(edges):
            rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[edges]
            breaks = np.flatnonzero((np.diff(edges) > 1) | (np.diff(rows) > 0)) + 1
            runs = np.concatenate([[0], breaks, [len(edges)]])
            values = hashed[codes[edges]]
            for length, (hashes, begins, ends, owners) in self.tables.items():
                at, window = windows(values, runs, length)
                first = np.searchsorted(hashes, window)
                same = hashes[np.minimum(first, len(hashes) - 1)] == window
                at, first, last = at[same], first[same], np.searchsorted(hashes, window[same], "right")
                seen: dict[tuple[int, bytes], bool] = {}  # a window that a text repeats is compared once
                for p, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
                    start, row = int(edges[p]), int(rows[p])
                    said = " ".join(dictionary.take(pa.array(codes[start : start + length])).to_pylist()).encode()
                    if (row, said) not in seen:
                        equal = [k for k in range(lo, hi) if self.plain[begins[k] : ends[k]] == said]
                        items[row].update(self.names[owner] for owner in owners[equal].tolist())
                        seen[row, said] = bool(equal)
                    if seen[row, said]:
                        hit[start] += 1
                        hit[start + length] -= 1
        return starts, np.cumsum(hit[:-1]) > 0, items


def _pieces(text: str, limit: int, size: int) -> Iterator[str]:
    """Parts of a long text, which share ``size - 1`` words: together they hold each of its windows, and no other one."""
    data = text.encode().translate(LOWER_WORDS)
    lately: deque[int] = deque(maxlen=size - 1)
    begin = end = held = 0
    for word in re.finditer(rb"[^ ]+", data):
        if held >= size and word.end() - begin > limit:
            yield data[begin:end].decode()
            begin, held = lately[0] if lately else word.start(), size - 1
        lately.append(word.start())
        end, held = word.end(), held + 1
    yield data[begin:end].decode()


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, size: int = WINDOW) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_bytes`` text bytes; longer ones in pieces; null texts have no window.

    The driver holds one block, which it has to broadcast. A piece has ``size`` words at least, if they are longer than the bound.
    """
    block, held = [], 0
    for item, text in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        for part in _pieces(text, block_bytes, size) if len(text.encode()) > block_bytes else [text]:
            length = len(part.encode())
            if block and held + length > block_bytes:
                yield block
                block, held = [], 0
            block.append((item, part))
            held += length
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``hit_spans`` (word ranges), ``item_ids`` and ``contaminated``.

    ``item_ids`` are strings in string order. A document is contaminated if at least a twentieth of its words is
    hit. Null texts have no words; repeated documents are judged one by one; an empty benchmark hits nothing. All
    rows and columns stay. With more benchmark text than ``block_bytes`` the documents are written once between two
    blocks; ``item_ids`` and spans of a block join the row when the next block passes over it.
    """
    clash = {"n_words", "n_hit", "hit_spans", "item_ids", "contaminated", "_hits", "_items"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.selectExpr("*", "0L AS n_words", "CAST(array() AS array<bigint>) AS _hits", "CAST(array() AS array<bigint>) AS _items")
    shared = None
    for block in item_blocks(benchmark, block_bytes, size):
        if shared is not None:  # finish with a block before the next one: a task never holds two
            out = stage(out, "decontaminated")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        out = _scan_block(out, shared, size)
    # Spans of all blocks: sorted (start, end) pairs, merged where they touch.
    pairs = "sort_array(transform(sequence(0, size(_hits) - 1, 2), i -> struct(_hits[i] AS start, _hits[i + 1] AS end)))"
    merged = f"""aggregate(IF(size(_hits) = 0, array(), {pairs}), CAST(array() AS array<struct<start: bigint, end: bigint>>),
        (acc, s) -> IF(size(acc) > 0 AND s.start <= element_at(acc, -1).end,
            concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start,
                greatest(element_at(acc, -1).end, s.end) AS end))), concat(acc, array(s))))"""
    out = out.withColumn("hit_spans", F.expr(merged)).withColumn(
        "n_hit", F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    )
    out = out.withColumn("item_ids", F.expr("array_sort(transform(array_distinct(_items), i -> CAST(i AS STRING)))"))
    return out.drop("_hits", "_items").withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def _scan_block(docs: DataFrame, block, size: int) -> DataFrame:
    name = uuid.uuid4().hex

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("windows")
        if name not in held:  # one set per worker: it is built from the broadcast texts, for this block only
            held.clear()
            held[name] = WindowSet(block.value, size)
        for batch in batches:
            for part in slices(batch):
                starts, hit, items = held[name].scan(part.column("text"))
                turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                spans: list[list[int]] = [[] for _ in items]
                for a, b in turns.reshape(-1, 2).tolist():
                    for row in range(rows[a], rows[b - 1] + 1):  # a run of hits may go on in the next text
                        first, last = int(starts[row]), int(starts[row + 1])
                        if last > first:
                            spans[row] += [max(a, first) - first, min(b, last) - first]
                columns = {name: part.column(name) for name in part.schema.names}
                columns["n_words"] = pa.array(np.diff(starts), pa.int64())
                kind = pa.list_(pa.int64())
                columns["_hits"] = pa.array([o + s for o, s in zip(columns["_hits"].to_pylist(), spans)], kind)
                columns["_items"] = pa.array([o + sorted(i) for o, i in zip(columns["_items"].to_pylist(), items)], kind)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(apply, docs.schema)
