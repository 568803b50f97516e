"""Scores from blocks of items against the plan that keeps grams as text."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrellis.operators import blocks, cider


def corpus(seed, size=30):
    rng = random.Random(seed)

    def sentence():
        return None if rng.random() < 0.1 else " ".join(rng.choice(["a", "B", "c-d", "é", "f1"]) for _ in range(rng.randint(0, 9)))

    return [(i, sentence(), [sentence() for _ in range(rng.randint(1, 4))]) for i in range(size)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, pred string, refs array<string>").repartition(3)


def tables(spark, rows):
    df = frame(spark, rows)
    return cider.captions_from_tables(df.select("item_id", "pred"), df.select("item_id", F.posexplode("refs").alias("ref_no", "ref")))


def table(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def as_text(caps, n=4, sigma=6.0):
    sums = cider._sums(cider.weighted_grams(caps, n), n, sigma)
    return table(sums.select("item_id", "n_refs", F.lit(10.0) * F.col("total") / n / F.col("n_refs")))


def test_whole_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    caps = cider.captions_from_arrays(frame(spark, corpus(1)))
    assert table(cider.score_items(caps)) == as_text(caps)


@pytest.mark.parametrize("captions", [lambda s, r: cider.captions_from_arrays(frame(s, r)), tables])
def test_items_that_come_twice(spark, captions):
    """Also with other texts, and references without a candidate."""
    caps = captions(spark, corpus(2, 12) + corpus(2, 6) + corpus(3, 4))
    assert table(cider.score_items(caps, n=3)) == as_text(caps, 3)


def test_references_that_come_twice(spark):
    rows = corpus(6, 10)
    df = frame(spark, rows)
    refs = df.select("item_id", F.posexplode("refs").alias("ref_no", "ref")).withColumn("ref_no", F.col("ref_no").cast("int"))
    refs = refs.union(refs.where("item_id < 4")).union(refs.where("item_id > 2").withColumn("ref", F.lit("a B c")))
    caps = cider.captions_from_tables(df.select("item_id", "pred"), refs)
    assert table(cider.score_items(caps)) == as_text(caps)


def test_references_without_a_candidate_take_no_part(spark):
    preds = spark.createDataFrame([(1, "a b"), (2, "b c d")], "item_id long, pred string")
    refs = spark.createDataFrame([(1, 0, "a b c"), (2, 0, "b c d"), (2, 1, ""), (3, 0, "a b"), (None, 0, "a")], "item_id long, ref_no int, ref string")
    caps = cider.captions_from_tables(preds, refs)
    assert table(cider.score_items(caps)) == as_text(caps)


def test_items_too_large_for_a_block(spark, monkeypatch):
    monkeypatch.setattr(cider, "ITEM_BYTES", 40)
    caps = cider.captions_from_arrays(frame(spark, corpus(4)))
    assert table(cider.score_items(caps)) == as_text(caps)
    w = cider.weighted_grams(caps).where("gram IS NOT NULL").groupBy("item_id", "ref_no", "n")
    want = table(w.agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)))))
    assert table(cider.sentence_norms(caps)) == want


def test_no_gram_is_left_behind(spark):
    """Grams are weighed when the scores are asked for; the result reads sums, and the blocks are gone."""
    scores = cider.score_items(cider.captions_from_arrays(frame(spark, corpus(5))))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        scores.explain()
    assert "gram" not in out.getvalue().replace("/grams-", "") and "Generate" in out.getvalue()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("captrellis_blocks")]


def test_order_of_hashes_that_differ_in_low_bits():
    found = np.array([9, 8, 9, 1 << 40, 8, 1], np.uint64)
    order, values = blocks._sorted(found)
    assert order.tolist() == np.argsort(found, kind="stable").tolist() and values.tolist() == sorted(found.tolist())


def test_words_are_told_apart_by_place():
    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)[[0, 1, 0, 0, 1, 1, 2, 0, 1]]
    grams = blocks.gram_hashes(words, 2)
    want = list(zip(words[:-1].tolist(), words[1:].tolist()))
    assert len(set(grams.tolist())) == len(set(want)) and grams[0] == grams[3] == grams[7]
    assert len(blocks.gram_hashes(words[:2], 3)) == 0
