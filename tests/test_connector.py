import numpy as np
import pytest
from pyspark.sql import functions as F

from captrellis.functions.vectors import image_seq_len, layer_norm, layer_norm_matrix, project, softmax, softmax_matrix
from captrellis.operators import connector

RNG = np.random.default_rng(3)


def patches(spark, images, side, d):
    x = RNG.normal(size=(images, side * side, d))
    rows = [(i, p, [float(v) for v in x[i, p]]) for i in range(images) for p in range(side * side)]
    return x, spark.createDataFrame(rows, "image_id long, patch_idx int, vec array<double>")


def merged_by_tensor(x, s):
    """Tile (i, j) is the concatenation of its s * s patches, row by row."""
    n, seq, d = x.shape
    side = int(seq**0.5)
    grid = x.reshape(n, side // s, s, side // s, s, d)
    return grid.transpose(0, 1, 3, 2, 4, 5).reshape(n, (side // s) ** 2, s * s * d)


def stacked(rows, column):
    return np.array([r[column] for r in sorted(rows, key=lambda r: (r["image_id"], r["patch_idx"]))])


@pytest.mark.parametrize("given_side", [None, 4])
@pytest.mark.parametrize("threshold", [5, 10**6])
def test_patch_merge(spark, given_side, threshold):
    x, df = patches(spark, 2, 4, 3)
    got = connector.patch_merge(df.repartition(3), 2, given_side, threshold).collect()
    assert np.allclose(stacked(got, "vec"), merged_by_tensor(x, 2).reshape(-1, 12))


def test_patch_merge_needs_whole_grids(spark):
    _, df = patches(spark, 1, 4, 2)
    with pytest.raises(Exception, match="square grid"):
        connector.patch_merge(df.where("patch_idx < 15"), 2).collect()
    with pytest.raises(Exception, match="incomplete tile"):
        connector.patch_merge(df.where("patch_idx < 15"), 2, side=4).collect()
    with pytest.raises(ValueError):
        connector.patch_merge(df, 0)


def codes(spark, n, d, logits=None):
    e = RNG.normal(size=(n, d))
    rows = [(i, [float(v) for v in e[i]]) + (([float(v) for v in logits[i]],) if logits is not None else ()) for i in range(n)]
    return e, spark.createDataFrame(rows, "code_id int, vec array<double>" + (", logit_vec array<double>" if logits is not None else ""))


def test_align_equals_the_dense_formula(spark):
    x, df = patches(spark, 2, 4, 3)
    w1, b1, w2 = RNG.normal(size=(5, 12)), RNG.normal(size=5), RNG.normal(size=(7, 5))
    e, book = codes(spark, 7, 4, w2)
    m = merged_by_tensor(x, 2).reshape(-1, 12)
    want = softmax_matrix(layer_norm_matrix(m @ w1.T + b1) @ w2.T) @ e
    for size in (10**9, 1):  # in one block, and in a block per code
        got = connector.align(df, book, 2, w1, b1, block_bytes=size).collect()
        assert np.allclose(stacked(got, "soft"), want, atol=1e-12)


@pytest.mark.parametrize("size", [1, 200, 10**6])
def test_blocked_softmax(spark, size):
    v = RNG.normal(size=(9, 4)) * 30
    e, book = codes(spark, 10, 4)
    df = spark.createDataFrame([(i, [float(a) for a in v[i]]) for i in range(9)], "k long, vec array<double>")
    got = {r["k"]: r["soft"] for r in connector.soft_assign(df, book, "k", block_bytes=size).collect()}
    want = softmax_matrix(v @ e.T) @ e
    assert np.allclose([got[i] for i in range(9)], want, atol=1e-12)
    with pytest.raises(ValueError, match="empty"):
        connector.soft_assign(df, book.limit(0), "k")


def test_norm_softmax_project(spark):
    v = RNG.normal(size=(6, 5))
    df = spark.createDataFrame([(i, [float(a) for a in v[i]]) for i in range(6)], "k long, vec array<double>").orderBy("k")
    w, b = RNG.normal(size=(3, 5)), RNG.normal(size=3)
    rows = df.select(layer_norm("vec").alias("n"), softmax("vec").alias("s"), project("vec", w, b).alias("p"), project("vec", w).alias("q")).collect()
    assert np.allclose([r["n"] for r in rows], layer_norm_matrix(v))
    assert np.allclose([r["s"] for r in rows], softmax_matrix(v)) and np.allclose([sum(r["s"]) for r in rows], 1)
    assert np.allclose([r["p"] for r in rows], v @ w.T + b) and np.allclose([r["q"] for r in rows], v @ w.T)
    with pytest.raises(Exception, match="5 numbers|4 numbers"):
        df.select(project("vec", RNG.normal(size=(3, 4)))).collect()
    with pytest.raises(ValueError):
        project("vec", w, b[:2])


def sequence(spark):
    """Batch 0: two samples; image token is 9, blocks of two."""
    rows = [(0, 0, p, t) for p, t in enumerate([1, 9, 9, 2])] + [(0, 1, p, t) for p, t in enumerate([9, 9, 3, 9, 9])]
    tokens = spark.createDataFrame(rows, "batch_id long, sample_id long, pos long, token_id int").withColumn("vec", F.array(F.lit(-1.0)))
    feats = spark.createDataFrame([(0, b, i, [float(10 * b + i)]) for b in range(4) for i in range(2)], "batch_id long, block_idx long, local_idx int, vec array<double>")
    return tokens, feats


def test_scatter(spark):
    tokens, feats = sequence(spark)
    got = connector.scatter_merge(tokens, feats, 9, 2).orderBy("sample_id", "pos").collect()
    assert [r["vec"][0] for r in got] == [-1, 0, 1, -1, 10, 11, -1, 20, 21]
    assert connector.surplus_blocks(tokens, feats, 9, 2).collect()[0]["surplus"] == 1


def test_scatter_errors(spark):
    tokens, feats = sequence(spark)
    with pytest.raises(Exception, match="missing feature row"):
        connector.scatter_merge(tokens, feats.where("block_idx < 2"), 9, 2).collect()
    with pytest.raises(Exception, match="not divisible by 2"):
        connector.scatter_merge(tokens.where("not (sample_id = 0 and pos = 1)"), feats, 9, 2).collect()


def test_positions_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(connector, "CHUNK_BITS", 1)
    tokens, feats = sequence(spark)
    got = connector.scatter_merge(tokens, feats, 9, 2).orderBy("sample_id", "pos").collect()
    assert [r["vec"][0] for r in got] == [-1, 0, 1, -1, 10, 11, -1, 20, 21]


def test_zero_images(spark):
    rows = [(0, 0, [0.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "batch_id long, pos long, vec array<double>")
    assert sorted((r["batch_id"], r["pos"]) for r in connector.drop_zero_images(df).collect()) == [(0, 1), (1, 0), (2, 5)]


def test_masks(spark):
    cells = spark.range(35).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 7).alias("y"), (F.col("id") % 7).alias("x"))
    assert connector.full_mask(cells).where("on").count() == 35
    mask = cells.where("y < 4").withColumn("on", (F.col("x") == 5) & (F.col("y") == 3))
    full = connector.full_mask(cells, mask)
    assert full.where("on").count() == 8
    tiles = {(r["ty"], r["tx"]): r["on"] for r in connector.tile_mask(full, 2, 5, 7).collect()}
    assert tiles == {(a, b): (a, b) == (1, 2) for a in range(2) for b in range(3)}


def test_sequence_length(spark):
    assert spark.range(1).select(image_seq_len(512, 16, 4).alias("n")).first()["n"] == 64
    assert spark.range(1).select(image_seq_len(50, 16, 2).alias("n")).first()["n"] == 2


@pytest.mark.parametrize("kw", [{}, {"inputs_embeds": 1}, {"input_ids": 1, "pixel_values": 1, "image_hidden_states": 1}])
def test_input_checks(kw):
    with pytest.raises(ValueError):
        connector.check_inputs(**kw)


def test_good_inputs():
    connector.check_inputs(input_ids=1, pixel_values=1)


def test_patch_tiles_keep_what_an_incomplete_image_has(spark):
    """Two images of 4 x 4, and a rest of two patches that make one half tile."""
    x, df = patches(spark, 2, 4, 3)
    rest = spark.createDataFrame([(2, 0, [1.0, 2.0, 3.0]), (2, 1, [4.0, 5.0, 6.0])], df.schema)
    got = connector.patch_tiles(df.union(rest), 2).collect()
    whole = sorted((r for r in got if r["image_id"] < 2), key=lambda r: (r["image_id"], r["patch_idx"]))
    assert np.allclose([np.concatenate([p["vec"] for p in r["parts"]]) for r in whole], merged_by_tensor(x, 2).reshape(-1, 12))
    assert [[p["place"] for p in r["parts"]] for r in whole] == [[0, 1, 2, 3]] * 8
    (last,) = [r for r in got if r["image_id"] == 2]
    assert [(p["place"], p["vec"]) for p in last["parts"]] == [(0, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])]


def test_patch_merge_query_takes_a_table_that_ends_inside_an_image(spark, tmp_path):
    from captrellis.queries.vectors import patch_merge

    rows = [(i, [float(i)] * 64, 0) for i in range(18)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = patch_merge(spark, str(tmp_path)).collect()
    assert len(got) == 18 * 64
    assert sorted((r["pos"], r["value"]) for r in got if r["image_id"] == 1) == [
        *[(i, 16.0) for i in range(64)], *[(128 + i, 17.0) for i in range(64)]
    ]


def test_patch_merge_query_leaves_out_a_full_tile_without_a_vector(spark, tmp_path):
    from captrellis.queries.vectors import patch_merge

    rows = [(i, None if i in (0, 17) else [float(i)] * 64, 0) for i in range(18)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["image_id"], r["patch_idx"], r["pos"]) for r in patch_merge(spark, str(tmp_path)).collect()}
    assert got == {(0, t, i) for t in (1, 2, 3) for i in range(256)} | {(1, 0, i) for i in range(64)}
