"""Whitening against dense decompositions of small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrellis.llm.whitening import Spectrum, Whitening, deviations, fit_whitening, fixed_point, identity_error, rank_one, whiten


@pytest.mark.parametrize("size, rows", [(1, 6), (2, 3), (7, 60), (24, 200), (24, 9)])
@pytest.mark.parametrize("block", [1, 5, 64])
def test_spectrum_equals_the_scatter(size, rows, block):
    rng = np.random.default_rng(size * rows + block)
    x = rng.integers(-60, 60, (rows, size)).astype(np.int64) + 1_000_000
    if size > 4:
        x[:, 3], x[:, 4] = x[:, 2], 5  # a repeated dimension and one without variance
        x[rows // 2 :] = x[: rows - rows // 2]
    parts = [Spectrum.empty(size) for _ in range(3)]
    for i, part in enumerate(parts):
        own = x[i * rows // 3 : (i + 1) * rows // 3]
        for start in range(0, len(own), block):
            part.add(own[start : start + block])
    total = Spectrum.empty(size)
    for part in parts:
        total.merge(part)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert total.n == rows and (total.sums == x.sum(axis=0)).all()
    rebuilt = (total.vectors * total.values) @ total.vectors.T
    assert np.abs(rebuilt - scatter).max() <= 1e-12 * np.abs(scatter).max()
    assert np.abs(total.vectors.T @ total.vectors - np.eye(size)).max() < 1e-12


def test_rank_one_deflates():
    values, vectors = rank_one(np.array([1.0, 1.0, 1.0, 4.0]), np.eye(4), np.array([3.0, 4.0, 0.0, 0.0]))
    assert np.allclose(values, [1, 1, 4, 26])
    assert np.allclose(np.abs(vectors[:, 3]), [0.6, 0.8, 0, 0])
    same, _ = rank_one(np.array([1.0, 2.0]), np.eye(2), np.zeros(2))
    assert np.allclose(same, [1, 2])


def test_deviations_beyond_a_long_are_none():
    x = np.array([[1 << 39, 0], [3, 4]], np.int64)
    sums = x.sum(axis=0)
    exact = [sum((2 * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert deviations(x, 2, sums) == [e if e < 1 << 63 else None for e in exact]


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.7, 0.4]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(c)]
    odd = [(900, None, "a"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "b"), (902, [float("nan")] * 6, "c"), (903, [float("inf")] * 6, "d"), (904, [], "e"), (905, [1e300] * 6, "f"), (906, [1.0], "g")]
    table = _table(spark, rows + odd + rows[:2]).repartition(5).withColumn("x", fixed_point("embedding"))
    model = fit_whitening(table)
    x = np.floor(64 * np.vstack([c, c[:2]])).astype(np.int64) + 1_000_000
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert model.n == 302 and (model.sums == x.sum(axis=0)).all()
    assert np.allclose(model.values, values[::-1], rtol=1e-12)
    out = {r.vec_id: r for r in whiten(table, model, components=4).collect()}
    expected = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    got = np.array([out[i].whitened for i in range(300)])
    assert np.allclose(got * np.sign((got * expected[:300]).sum(axis=0)), expected[:300], atol=1e-8)
    assert [out[i].deviation for i in range(300)] == ((302 * x - x.sum(axis=0)) ** 2).sum(axis=1)[:300].tolist()
    assert all(out[i].whitened is None and out[i].deviation is None and out[i].n for i in range(900, 907))
    assert identity_error(table, model, components=6) < 1e-9


def test_constant_and_empty_tables(spark):
    one = _table(spark, [(i, [1.0, 2.0], "x") for i in range(3)]).withColumn("x", fixed_point("embedding"))
    model = fit_whitening(one)
    assert model.kept(2) == 0 and identity_error(one, model) == 0
    assert [r.whitened for r in whiten(one, model).collect()] == [[]] * 3
    none = one.where("vec_id > 9")
    assert fit_whitening(none) is None and whiten(none, None).count() == 0
    with pytest.raises(ValueError):
        whiten(one.withColumn("deviation", F.lit(1)), None)


def test_null_keys_stay(spark):
    table = _table(spark, [(None, [float(i), float(i * i)], None) for i in range(4)]).withColumn("x", fixed_point("embedding"))
    assert whiten(table, fit_whitening(table)).where("whitened IS NOT NULL").count() == 4


def test_signs_do_not_depend_on_rows():
    model = Whitening(2, np.array([2, 0]), np.array([1.0, 0.0]), np.eye(2), 1.0)
    assert model.kept(2) == 1
    assert model.project(np.array([[2, 0], [0, 0]]), 2).tolist() == [[1.0], [-1.0]]
