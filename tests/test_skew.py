import pytest
from pyspark.sql import functions as F

from captrellis.operators import skew


@pytest.fixture()
def tables(spark):
    big = spark.range(1000).select(
        F.col("id").alias("row"), F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    big = big.unionByName(spark.createDataFrame([(2000, None), (2001, "absent")], "row long, key string"))
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "key string, v int")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("threshold", [10, 100, 10**6])
def test_salted_join_equals_plain_join(tables, how, threshold):
    big, small = tables
    got = skew.salted_join(big, small, ["key"], spread_by=["row"], how=how, threshold=threshold)
    want = big.join(small, ["key"], how)
    assert sorted(map(str, got.select("key", "row", "v").collect())) == sorted(map(str, want.select("key", "row", "v").collect()))


def test_hot_key_gets_salts(tables):
    big, _ = tables
    assert {r["key"]: r["_salts"] for r in skew.hot_keys(big, ["key"], 100).collect()} == {"hot": 6}


def test_salted_join_rejects_other_kinds(tables):
    with pytest.raises(ValueError):
        skew.salted_join(*tables, ["key"], ["row"], how="outer")


@pytest.mark.parametrize("threshold", [10, 10**6])
def test_lookup_equals_left_join(tables, threshold):
    big, small = tables
    uses = big.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("uses"))
    got = skew.lookup(big, small.join(uses, "key"), "key", "v", ["row"], "uses", threshold)
    want = big.join(small, "key", "left")
    assert sorted(map(str, got.select("key", "row", "v").collect())) == sorted(map(str, want.select("key", "row", "v").collect()))


def test_first_k(tables):
    big, _ = tables
    got = skew.first_k(big.where("key = 'hot'"), ["key"], ["row"], 2).collect()
    assert [r["row"] for r in sorted(got)] == [0, 1]
