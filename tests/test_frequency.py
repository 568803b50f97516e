"""Document frequencies kept as changes against a full count."""

import pytest
from pyspark.sql import functions as F

from captrellis.operators import cider, frequency


def corpus(spark):
    rows = [(i, f"a b{i % 3} c", [f"a b{i % 2} c", f"b{i % 3} c d{i}", None][: i % 3 + 1]) for i in range(12)]
    caps = cider.captions_from_arrays(spark.createDataFrame(rows, "item_id long, pred string, refs array<string>"))
    return caps, caps.cands.select("item_id"), caps.pairs.select("item_id", "ref_no", "ref")


def scores(df):
    return {r.item_id: round(r.cider, 9) for r in df.collect()}


def table(found):
    return {r.gram: (r.df, r.uses) for r in found.grams.collect()}


def test_scores_equal_a_full_run(spark, tmp_path):
    caps, ids, refs = corpus(spark)
    store = str(tmp_path / "store")
    assert frequency.add_items(store, "one", ids.where("item_id < 7"), refs)
    assert frequency.add_items(store, "two", ids.where("item_id >= 7"), refs)
    assert frequency.withdraw_items(store, "three", ids.where("item_id % 4 = 1"), refs)
    left = cider.Captions(*[t.where("item_id % 4 <> 1") for t in caps])
    want = scores(cider.score_items(left))
    found = frequency.read_frequency(spark, store)
    assert scores(cider.score_items(left, frequency=found)) == want and len(want) == 9
    frequency.compact(spark, store, str(tmp_path / "compact"))
    small = frequency.read_frequency(spark, str(tmp_path / "compact"))
    assert table(small) == table(found)
    assert scores(cider.score_items(left, frequency=small)) == want
    # An item that comes back counts again.
    assert frequency.add_items(store, "four", ids.where("item_id % 4 = 1"), refs)
    assert scores(cider.score_items(caps, frequency=frequency.read_frequency(spark, store))) == scores(cider.score_items(caps))


def test_a_job_started_again_changes_nothing(spark, tmp_path):
    _, ids, refs = corpus(spark)
    store = str(tmp_path / "store")
    assert frequency.add_items(store, "one", ids, refs)
    before = table(frequency.read_frequency(spark, store))
    assert not frequency.add_items(store, "one", ids, refs)
    # A change that was cut off before its items were written does not count, and is written anew.
    spark.createDataFrame([("zz", 5, 5)], "gram string, df long, uses long").write.parquet(f"{store}/grams/change=two")
    assert table(frequency.read_frequency(spark, store)) == before
    assert frequency.withdraw_items(store, "two", ids, refs)
    assert table(frequency.read_frequency(spark, store)) == {}


def test_misuse_is_an_error(spark, tmp_path):
    _, ids, refs = corpus(spark)
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no finished change"):
        frequency.read_frequency(spark, store)
    with pytest.raises(ValueError, match="name"):
        frequency.add_items(store, "a/b", ids, refs)
    frequency.add_items(store, "one", ids, refs)
    frequency.add_items(store, "two", ids.where("item_id = 3"), refs)
    with pytest.raises(Exception, match="more than once: 3"):
        frequency.compact(spark, store, str(tmp_path / "compact"))


def test_items_without_references_and_empty_changes(spark, tmp_path):
    _, ids, refs = corpus(spark)
    store = str(tmp_path / "store")
    frequency.add_items(store, "none", ids.where(F.lit(False)), refs)
    frequency.add_items(store, "bare", ids, refs.where(F.lit(False)))
    found = frequency.read_frequency(spark, store)
    assert table(found) == {} and spark.range(1).select(found.n_items.alias("n")).first().n == 12
