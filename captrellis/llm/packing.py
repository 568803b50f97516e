"""Packing of documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the square of a piece's length). Pieces come in
falling size. Each goes to the open sequence that has room for it under every constraint and, by choice, the smallest
weighted norm of what is left afterwards or the largest weighted dot product of what is left with what it needs.

Pieces that fill a sequence alone need no partner. The others are dealt into groups of about equal, bounded size by a
hash of their row, each packed by one task; sequences that a group could not fill are opened and dealt anew into fewer groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches, slices, worker_cache
from captrellis.llm.tokens import ByteTokens
from captrellis.session import stage

MAX_TOKENS = 2048
#: Pieces that one task packs.
GROUP_PIECES = 4_096
#: A sequence that is less full than this is opened again in the next round.
FULL = 0.99
ROUNDS = 3
#: Weights of the free shares of tokens, documents and attention cost.
WEIGHTS = (1.0, 1e-3, 1e-2)


def token_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """``key, row, piece, start, length, ids_crc32`` (and ``ids``, packed little-endian 32-bit) per piece of a document.

    A document is the ids of its text and ``end_id``; null texts are empty. One of more than ``max_tokens`` ids is cut
    into full pieces, the first of which may be shorter. ``row + piece`` is unique; keys may repeat or be null.
    """
    bounded_batches(docs.sparkSession)
    path, kind = str(Path(path).absolute()), docs.schema[key].dataType.simpleString()
    fields = f"key {kind}, row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("packers")
        if path not in held:
            held[path] = ByteTokens(path, special=True)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                origin, found = [], []
                for i, t in enumerate(part.column("text")):
                    ids = np.array([*held[path].encode(t.as_py() or ""), end_id], "<u4")
                    cuts = [0, *range(len(ids) % max_tokens or max_tokens, len(ids), max_tokens), len(ids)]
                    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        packed = ids[a:b].tobytes()
                        origin.append(i)
                        found.append((row, n, a, b - a, zlib.crc32(packed), packed if keep_ids else None))
                    row += len(cuts) - 1
                columns = list(zip(*found))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["row", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(origin)), *arrays], ["key", *names])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(apply, fields).withColumnRenamed("key", key)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, in falling order of size; ``capacity`` of tokens, pieces and attention cost."""
    needs = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    if (needs > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    shares = needs / capacity
    order = np.lexsort((np.arange(len(lengths)), -(shares * weights).sum(axis=1)))
    least = np.array([lengths.min(initial=1), 1, lengths.min(initial=1) ** 2])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, number = np.empty((len(lengths), 3), np.int64), np.empty(len(lengths), np.int64)
    n_open = n_all = 0
    for i in order.tolist():
        need = needs[i]
        room = left[:n_open]
        fits = np.flatnonzero((room >= need).all(axis=1))
        if len(fits):
            if rule == "dot":
                score = -((room[fits] / capacity) @ (weights * shares[i]))
            else:
                rest = (room[fits] - need) / capacity
                score = (rest * rest) @ weights
            at = int(fits[np.argmin(score)])
        else:
            at, n_open = n_open, n_open + 1
            left[at], number[at] = capacity, n_all
            n_all += 1
        sequence[i], offset[i] = number[at], capacity[0] - left[at, 0]
        left[at] -= need
        if (left[at] < least).any():  # nothing fits any more: the last open sequence takes its place
            n_open -= 1
            left[at], number[at] = left[n_open], number[n_open]
    return sequence, offset


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` (with ``row, piece, length``) plus ``sequence_id`` and ``offset``.

    Without the optional limits a sequence holds ``max_tokens`` pieces and an attention cost of ``max_tokens`` squared,
    which tokens imply. Every piece is placed once; a piece larger than a sequence is an error. ``pieces`` must be a
    stored table. Sequences of different groups never share a number. An empty table gives an empty result.
    """
    if rule not in ("norm", "dot") or not 0 < group_pieces < 1 << 22 or rounds < 1:
        raise ValueError("rule is 'norm' or 'dot', group_pieces at most 4 million, and there is at least one round")
    clash = {"sequence_id", "offset", "_group", "_filled"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens * max_tokens], np.int64)
    weight = np.array(weights, float)
    columns = pieces.columns
    placed = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("_filled"))

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        sequence, offset = best_fit(lengths, capacity, weight, rule)
        filled = np.bincount(sequence, weights=lengths)[sequence].astype(np.int64)
        table = table.select(columns).append_column("sequence_id", pa.array((key[0].as_py() << 24) + sequence))
        return table.append_column("offset", pa.array(offset)).append_column("_filled", pa.array(filled))

    if (capacity[2] < max_tokens * max_tokens) and pieces.where(F.col("length") == max_tokens).count():
        raise ValueError("a full piece costs more attention than a sequence may")
    # Full pieces stand alone; their sequences are numbered below zero.
    alone = placed.where(F.col("length") == max_tokens).withColumn("sequence_id", F.expr("-1 - row - piece"))
    done, rest = [alone], pieces.where(F.col("length") != max_tokens)
    before = 0
    for n in range(rounds):
        left = rest.count()
        groups = max(1, -(-left // group_pieces))
        dealt = rest.withColumn("_group", before + F.pmod(F.xxhash64(F.lit(n), "row", "piece"), F.lit(groups)))
        packed = stage(dealt.groupBy("_group").applyInArrow(apply, placed.schema), "packing-round")
        before += groups
        if groups == 1 or n == rounds - 1:
            done.append(packed)
            break
        least = int(FULL * max_tokens)
        done.append(packed.where(F.col("_filled") >= least))
        rest = packed.where(F.col("_filled") < least).select(*columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_filled")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths``: the joined ids of every sequence and its pieces' lengths, which end its attention blocks.

    ``packed`` needs the ids of its pieces; a sequence is at most ``max_tokens`` ids, so a group is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(rows.alias("p"))
    ids = F.expr("aggregate(p, CAST('' AS BINARY), (acc, x) -> concat(acc, x.ids))")
    return joined.select("sequence_id", ids.alias("ids"), F.expr("transform(p, x -> x.length)").alias("lengths"))
