import math

import pytest
from pyspark.sql import functions as F

from captrellis.functions.hashing import pick
from captrellis.operators import ordering
from captrellis.session import stage


def numbers(spark, n):
    return spark.range(n).select((F.col("id") * 7 + 3).alias("k"))


@pytest.mark.parametrize("n", [0, 1, 10, 997])
def test_split_sizes(spark, n):
    got = ordering.train_test_split(numbers(spark, n), ["k"], 0.1, 42).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    assert sizes.get("test", 0) == math.ceil(0.1 * n) and sum(sizes.values()) == n


@pytest.mark.parametrize("fraction", [0.0, 0.35, 1.0])
def test_sample_size_and_membership(spark, fraction):
    df = numbers(spark, 500)
    got = ordering.exact_sample(df, ["k"], fraction, 1)
    assert got.count() == int(fraction * 500)
    assert got.subtract(df).count() == 0


def test_sample_is_the_head_of_the_shuffle(spark):
    df = numbers(spark, 300)
    head = [r["k"] for r in ordering.shuffled(df, ["k"], 9).limit(105).collect()]
    assert sorted(head) == sorted(r["k"] for r in ordering.exact_sample(df, ["k"], 0.35, 9).collect())


def test_sample_needs_unique_keys(spark):
    with pytest.raises(ValueError, match="identify every row"):
        ordering.exact_sample(spark.createDataFrame([(1,)] * 10, "k long"), ["k"], 0.5, 1)


def test_fraction_is_checked(spark):
    with pytest.raises(ValueError):
        ordering.hash_cut(numbers(spark, 3), ["k"], 1.5, 1, "floor")
    with pytest.raises(ValueError):
        ordering.hash_cut(numbers(spark, 3), ["k"], 0.5, 1, "nearest")


def test_numbering_is_a_permutation_and_partition_independent(spark):
    df = numbers(spark, 400)
    one = ordering.number_shuffled(df.repartition(1), ["k"], 3, total="n").collect()
    seven = ordering.number_shuffled(df.repartition(7), ["k"], 3, total="n").collect()
    assert sorted(one) == sorted(seven)
    assert sorted(r["rn"] for r in one) == list(range(1, 401)) and {r["n"] for r in one} == {400}
    order = [r["k"] for r in ordering.shuffled(df, ["k"], 3).collect()]
    assert order == [r["k"] for r in sorted(one, key=lambda r: r["rn"])]


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_number_by_key(spark, range_rows):
    df = spark.createDataFrame([(x,) for x in [5, -3, 10**12, 0, 7, 8, 9, 10**15]], "k long")
    got = sorted((r["k"], r["rn"]) for r in ordering.number_by_key(df, "k", range_rows=range_rows).collect())
    assert [rn for _, rn in got] == list(range(1, 9))


def test_number_by_key_of_nothing(spark):
    assert ordering.number_by_key(spark.createDataFrame([], "k long"), "k").count() == 0


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COUNTS_IN_TASK", 7)  # prefix sums over several groups of ranges
    stored = []
    monkeypatch.setattr(ordering, "stage", lambda d, name: stored.append(stage(d, name)) or stored[-1])
    df = numbers(spark, 500).withColumn("kind", F.col("k") % 3)
    out = ordering.numbered(df, [F.col("kind").desc(), "k"], total="n", range_rows=10)
    got = sorted(out.collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in got] == list(range(1, 501)) and {r["n"] for r in got} == {500}
    assert [(-r["kind"], r["k"]) for r in got] == sorted((-r["kind"], r["k"]) for r in got)
    assert stored[0].select(F.input_file_name()).distinct().count() >= 40


def test_cut_by_single_steps(spark):
    df = numbers(spark, 200)
    order = [r["k"] for r in ordering.shuffled(df, ["k"], 6).collect()]
    hashes = {r["k"]: r["h"] for r in df.select("k", ordering.order_key(6, "k").alias("h")).collect()}
    for n in (1, 77, 200):  # ranges of one row: digits are followed until a place holds one row
        assert ordering._cut_at(df, ["k"], 6, n, range_rows=1) == hashes[order[n - 1]]
    assert ordering._cut_at(df, ["k"], 6, 201) is None


def test_row_at(spark):
    df = numbers(spark, 50)
    want = ordering.shuffled(df, ["k"], 4).collect()[10]["k"]
    row = ordering.row_at(df, ["k"], 10, 4)
    assert [r["k"] for r in row.collect()] == [want]
    assert ordering.row_at(df, ["k"], 50, 4).isEmpty()
    with pytest.raises(ValueError):
        ordering.row_at(df, ["k"], -1, 4)


def test_draws(spark):
    df = numbers(spark, 40)
    got = ordering.few_shot_draws(df, "k", 3, 8).collect()
    assert len(got) == 120 and {r["shot"] for r in got} == {1, 2, 3}
    keys = {r["k"] for r in df.collect()}
    assert {r["shot_k"] for r in got} <= keys
    alone = ordering.few_shot_draws(df, "k", 3, 8, exclude_self=True).collect()
    assert len(alone) == 120 and all(r["k"] != r["shot_k"] for r in alone)
    with pytest.raises(ValueError):
        ordering.few_shot_draws(df, "k", 0, 1)


def test_pick_is_repeatable_and_in_range(spark):
    df = numbers(spark, 200)
    a = [r[0] for r in df.select(pick(20, "s", "k")).collect()]
    b = [r[0] for r in df.repartition(5).sort("k").select(pick(20, "s", "k")).collect()]
    assert a == b and set(a) == set(range(20))
