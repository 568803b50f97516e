"""Alignment of the tokens of two tokenizers over the same text.

Per text, a dictionary leads from the byte offsets at which one side's tokens end to their indexes. The other side's
ends are looked up in it: common offsets, in rising order, slice both id lists into groups that cover the same bytes.
Every token of a group is linked with every token of the other side.

Id pairs are counted by the number of texts that link them. Texts are never shuffled: each is encoded once into a
staged row with its pairs, the pairs are counted with map-side sums, and the table of counts comes back to the staged
rows in blocks of bounded size as broadcasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches, slices, worker_cache
from captrellis.llm.tokens import ByteTokens
from captrellis.session import stage

#: Id pairs in one broadcast block: three longs each, some 100 MB as a hash table. More pairs mean more blocks.
PAIR_BLOCK = 1_000_000
#: Links expanded at a time.
LINK_STEP = 1 << 20
#: A pair is held as one long: the second id in the low bits.
ID_BITS = 32


class PieceTokens:
    """Ids of a sentence-piece model; it puts a blank in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        m = self.model
        pieces = ((i, m.id_to_piece(i)) for i in range(m.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode() for i, p in pieces]


class Aligner:
    """Both tokenizers with the bytes and the printed form of their ids."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteTokens(byte_path, special=False), PieceTokens(piece_path)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # Byte-level merges only join neighbours: with a token for every byte they spell any text.
        self.spells = {bytes([i]) for i in range(256)} <= set(self.bytes_a)
        # Every id as it is printed inside a group and at the end of its side of a group, as rows of bytes.
        shown = [f"{i}{mark}".encode() for ids, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for mark in (",", last) for i in range(ids)]
        width = max(map(len, shown))
        self.printed = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in shown), np.uint8).reshape(-1, width)
        self.filled = self.printed > 0

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of both sides and the byte ends of both; none for empty texts and where the tokens' bytes are not blank and text."""
        none = np.empty(0, np.int64)
        for text, b in zip(texts, self.b.encode([t or "" for t in texts])):
            whole = " " + (text or "")
            a = self.a.encode(whole) if text else []
            whole = whole.encode()
            ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
            same = text and ends_a[-1:] == ends_b[-1:] == len(whole) and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            if same and not self.spells:
                same = b"".join(map(self.bytes_a.__getitem__, a)) == whole
            yield (ids_a, ids_b, ends_a, ends_b) if same else (none, none, none, none)

    def cuts(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the groups as token counts of either side: byte ends of one found in the dictionary of the other's."""
        index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
        found = np.fromiter(map(index_a.get, ends_b.tolist(), repeat(0)), np.int64, len(ends_b))
        common = np.flatnonzero(found)  # in rising order, like the ends
        return found[common], common + 1

    def shown(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of all groups in decimal."""
        size_a, size_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cuts_a - 1], last_b[cuts_b - 1] = True, True
        out = np.empty(len(a) + len(b), np.int64)
        # Before a token of the first side stand the second side's earlier groups; before one of the second, its own group too.
        out[np.arange(len(a)) + np.repeat(cuts_b - size_b, size_a)] = a + last_a * len(self.bytes_a)
        out[np.arange(len(b)) + np.repeat(cuts_a, size_b)] = b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        return self.printed[out][self.filled[out]].tobytes()[:-1]


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a text, packed and sorted, and how many links each has."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    # Every token of the first side is linked with the tokens of its group: `fan` of them, from `first` on.
    fan, first = np.repeat(size_b, size_a), np.repeat(ends_b - size_b, size_a)
    pairs, links = [], []
    through = np.cumsum(fan)
    start, done = 0, 0
    while start < len(ids_a):
        stop = max(start + 1, int(np.searchsorted(through, done + LINK_STEP, side="right")))
        own = fan[start:stop]
        at = np.arange(own.sum()) + np.repeat(first[start:stop] - np.cumsum(own) + own, own)
        packed = np.repeat(ids_a[start:stop] << ID_BITS, own) | ids_b[at]
        packed.sort()
        fresh = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        pairs.append(packed[fresh])
        links.append(np.diff(fresh, append=len(packed)))
        start, done = stop, int(through[stop - 1])
    if len(pairs) < 2:
        return (pairs[0], links[0]) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(links)).astype(np.int64)


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links`` per row of ``docs``.

    ``pairs`` are the distinct linked id pairs (``a * 2^32 + b``, ascending) and ``links`` their numbers; ``row`` is
    unique. Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and
    an empty ``groups_sha256``. Null and repeated keys are rows like others.
    """
    bounded_batches(docs.sparkSession)
    # A name without folders would be looked up on the executors: both paths must be whole.
    paths = (str(Path(byte_path).absolute()), str(Path(piece_path).absolute()))
    fields = "key {0}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("aligners")
        if paths not in held:
            held[paths] = Aligner(*paths)
        aligner, number = held[paths], TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {c: [] for c in ("row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")}
                for a, b, ends_a, ends_b in aligner.tokens(part.column("text").to_pylist()):
                    cuts = aligner.cuts(ends_a, ends_b)
                    pairs, links = linked_pairs(a, b, *cuts)
                    digest = hashlib.sha256(aligner.shown(a, b, *cuts)).hexdigest() if len(a) else ""
                    row = (number, len(a), len(b), len(cuts[0]), int(links.sum()), digest, pairs, links)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    number += 1
                lists = []
                for c in ("pairs", "links"):
                    borders = np.cumsum([0, *map(len, out[c])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(borders, pa.array(np.concatenate(out[c]))))
                plain = [pa.array(out[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in list(out)[:6]]
                yield pa.RecordBatch.from_arrays([part.column("key"), *plain, *lists], ["key", *out])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(apply, fields.format(kind)).withColumnRenamed("key", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: texts that link each id pair, and whether no pair of the same first id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = stage(counts, "alignment-pairs").withColumn("a", F.shiftright("pair", ID_BITS))
    tops = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return stage(counts.join(tops, "a").selectExpr("pair", "docs", "docs = top AS best"), "alignment-counts")


def alignment_counts(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", block: int = PAIR_BLOCK) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` per row of ``docs``.

    ``n_best`` counts links whose pair is linked by at least as many texts as any other pair of the same first id;
    ``count_sum`` adds up the pair's number of texts over all links. Repeated rows are texts of their own in the
    counts; an empty table gives an empty result. See :func:`align` for odd texts.
    """
    aligned = stage(align(docs, byte_path, piece_path, key, text), "alignment-rows")
    counts = pair_counts(aligned)
    blocks = max(1, -(-counts.count() // block))
    narrow = [c for c in aligned.columns if c not in ("pairs", "links")]
    exploded = aligned.select(*narrow, F.explode_outer(F.arrays_zip("pairs", "links")).alias("l")).select(*narrow, "l.pairs", "l.links")
    parts = []
    for i in range(blocks):
        # At most about `block` pairs: the hash deals them evenly.
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i)
        met = exploded.join(F.broadcast(own), exploded["pairs"] == own["pair"], "left")
        # All links of a row lie in one task, so the sums shrink to one narrow row per text before they move.
        parts.append(
            met.groupBy(*narrow).agg(
                F.sum(F.expr("IF(best, links, 0L)")).alias("n_best"), F.sum(F.expr("coalesce(docs * links, 0L)")).alias("count_sum")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if blocks > 1:
        out = out.groupBy(*narrow).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.drop("row")
