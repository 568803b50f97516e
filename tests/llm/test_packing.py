"""Packing: every piece once, no capacity broken, few sequences; pieces against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from captrellis.llm.packing import best_fit, pack, sequences, token_pieces
from captrellis.session import stage

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _pieces(spark, lengths):
    rows = [(None if i % 5 == 0 else i % 7, i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    return stage(spark.createDataFrame(rows, schema).repartition(3), "pieces")


def _check(rows, lengths, limit, documents=None, attention=None):
    assert sorted(r.row for r in rows) == list(range(len(lengths)))
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([0, *[n for _, n in parts]])
        assert [o for o, _ in parts] == ends[:-1].tolist() and ends[-1] <= limit
        assert len(parts) <= (documents or limit) and sum(n * n for _, n in parts) <= (attention or limit * limit)
    return len(held)


def plain_best_fit(lengths, limit, documents, attention):
    """The norm rule over all open sequences, in plain Python."""
    size = lambda n: n / limit + 1e-3 / documents + 1e-2 * n * n / attention
    bins = []
    for n in sorted(lengths, key=lambda n: -size(n)):
        best = None
        for b in bins:
            rest = (limit - b[0] - n, documents - b[1] - 1, attention - b[2] - n * n)
            if min(rest) >= 0:
                norm = (rest[0] / limit) ** 2 + 1e-3 * (rest[1] / documents) ** 2 + 1e-2 * (rest[2] / attention) ** 2
                if best is None or norm < best[0] - 1e-15:
                    best = (norm, b)
        if best is None:
            bins.append([n, 1, n * n])
        else:
            best[1][0] += n
            best[1][1] += 1
            best[1][2] += n * n
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("limit, documents, attention", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 5_000), (64, 3, 2_500)])
def test_best_fit_equals_plain(limit, documents, attention):
    rng = np.random.default_rng(limit + documents)
    lengths = rng.integers(1, 50, 300)
    sequence, _ = best_fit(lengths, np.array([limit, documents, attention]), np.array([1.0, 1e-3, 1e-2]))
    got = [(int(lengths[sequence == s].sum()), int((sequence == s).sum()), int((lengths[sequence == s] ** 2).sum())) for s in np.unique(sequence)]
    assert sorted(got) == plain_best_fit(lengths.tolist(), limit, documents, attention)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_groups_and_rounds_fill_sequences(spark, rule):
    lengths = np.concatenate([np.random.default_rng(5).integers(1, 101, 3000), np.full(1500, 37), [100, 100]])
    rows = pack(_pieces(spark, lengths), 100, group_pieces=200, rule=rule).collect()
    alone = best_fit(lengths, np.array([100, 100, 10_000]), np.array([1.0, 1e-3, 1e-2]), rule)[0].max() + 1
    assert _check(rows, lengths, 100) <= 1.02 * alone
    # Where pieces are small, groups come within a hundredth of the lower bound.
    fine = np.random.default_rng(7).integers(1, 41, 8000)
    rows = pack(_pieces(spark, fine), 100, group_pieces=1000, rule=rule).collect()
    assert _check(rows, fine, 100) <= 1.01 * -(-fine.sum() // 100) + 1


def test_every_constraint_binds(spark):
    lengths = np.random.default_rng(6).integers(1, 60, 800)
    assert _check(pack(_pieces(spark, lengths), 100, max_documents=3, group_pieces=100).collect(), lengths, 100, 3) >= 267
    _check(pack(_pieces(spark, lengths), 100, max_attention=4000, group_pieces=100).collect(), lengths, 100, None, 4000)
    with pytest.raises(Exception, match="larger than a sequence|costs more attention"):
        pack(_pieces(spark, [101]), 100).collect()
    with pytest.raises(ValueError):
        pack(_pieces(spark, [100]), 100, max_attention=99)
    with pytest.raises(ValueError):
        pack(_pieces(spark, [1]).withColumn("offset", F.lit(1)))


def test_pieces_equal_the_library(spark):
    texts = [None, "", "word " * 3000, "a<|endoftext|>b", "x " * 2046 + "y", "x " * 2046, " " * 3000, "short", "short"]
    docs = spark.createDataFrame([(i if i < 7 else 7, t, "row") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    found = stage(token_pieces(docs.repartition(3), PATH, keep_ids=True), "pieces")
    rows = found.orderBy("doc_id", "row", "piece").collect()
    library, expected = Tokenizer.from_file(PATH), []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected.append((min(i, 7), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows] == expected
    assert len({r.row + r.piece for r in rows}) == len(rows)
    packed = pack(found)
    joined = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in packed.collect():
        own = joined[r.sequence_id]
        assert bytes(own.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
        assert sum(own.lengths) == len(own.ids) // 4 <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(stage(token_pieces(docs, PATH), "pieces")).count() == 0
