"""Whole jobs on small made-up tables, and the stateless operators on a stream."""

import sys
from pathlib import Path

import pytest
import test_assets
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_assets import png

from captrellis.functions import chat
from captrellis.functions.text import tokens
from captrellis.operators import batching
from captrellis.plans import jobs
from captrellis.sources.fetch import FetchTimeout, Response
from captrellis.sources.store import with_bodies
from captrellis.streaming import append_stream

# Tasks cannot import test modules.
for module in (sys.modules[__name__], test_assets):
    cloudpickle.register_pickle_by_value(module)


def fetcher(url, attempt):
    kind = url.split("/")[-1]
    if kind == "0":
        raise FetchTimeout()
    return Response("image/png", {"1": b"junk", "2": png(10, 10)}.get(kind, png(64, 64)))


def test_prepare_urls(spark, tmp_path):
    raw = spark.range(40).select("id", F.concat(F.lit("http://h/"), F.col("id") % 5).alias("image_url"), F.lit("c").alias("caption"))
    raw.write.parquet(str(tmp_path / "raw"))
    conf = {"input": str(tmp_path / "raw"), "output": str(tmp_path / "out"), "key": "id", "fraction": 1.0, "delay": 0.0, "tasks": 2}
    report = jobs.prepare_urls(spark, conf, fetcher)
    assert report == {"corrupted": 8, "small_or_mode": 8, "high_res": 0, "total_removed": 24, "final_size": 16}
    out = spark.read.parquet(conf["output"])
    assert out.count() == 16 and set(out.columns) == {"id", "image_url", "caption", "image_path"}
    assert {bytes(r.content) for r in with_bodies(out).collect()} == {png(64, 64)}
    conf.update(output=str(tmp_path / "out2"), fraction=0.35)
    assert jobs.prepare_urls(spark, conf, fetcher)["final_size"] <= 14
    with pytest.raises(ValueError, match="image_url"):
        raw.drop("image_url").write.parquet(str(tmp_path / "bad"))
        jobs.prepare_urls(spark, {**conf, "input": str(tmp_path / "bad")}, fetcher)


def test_prepare_narratives(spark, tmp_path):
    rows = [(1, [bytearray(png(60, 60)), bytearray(b"x")]), (2, []), (3, [bytearray(b"x")]), (4, None)]
    df = spark.createDataFrame(rows, "id long, images array<binary>").withColumn("texts", F.array(F.struct(F.lit("u").alias("user"), F.lit("a").alias("assistant"))))
    df.write.parquet(str(tmp_path / "raw"))
    report = jobs.prepare_narratives(spark, {"input": str(tmp_path / "raw"), "output": str(tmp_path / "out"), "key": "id"})
    assert report["final_size"] == 1 and report["corrupted"] == 1 and report["total_removed"] == 3
    out = spark.read.parquet(str(tmp_path / "out")).first()
    assert out["id"] == 1 and out["image_path"].endswith(".PNG") and Path(out["image_path"]).read_bytes() == png(60, 60)


def test_build_batches(spark, tmp_path):
    caps = spark.range(11).select("id", F.concat(F.lit("p"), "id").alias("image_path"), F.concat(F.lit("a cat "), "id").alias("caption"))
    caps.write.parquet(str(tmp_path / "caps"))
    vocab = batching.build_vocab(caps.select(tokens("caption").alias("t")), "t")
    vocab.write.parquet(str(tmp_path / "vocab"))
    conf = {"input": str(tmp_path / "caps"), "output": str(tmp_path / "out"), "vocab": str(tmp_path / "vocab"), "key": "id"}
    out = jobs.build_batches(spark, conf)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 9, "test": 2}
    widths = out.groupBy("split", "batch_id").agg(F.count_distinct(F.size("input_ids")).alias("w"), F.count("*").alias("n")).collect()
    assert all(r["w"] == 1 and r["n"] <= 4 for r in widths)
    r = out.first()
    assert r["input_ids"].count(batching.IMAGE_ID) == 1 and batching.IMAGE_ID not in r["labels"]
    # Every row carries its image, so a trainer can read the bodies of a batch.
    assert sorted((r.id, r.image_path) for r in out.collect()) == [(i, f"p{i}") for i in range(11)]


def echo():
    return lambda prompts, images: [i[-1].split("/")[-1] for i in images]


@pytest.mark.parametrize("shots", [False, True])
def test_evaluate(spark, tmp_path, shots):
    items = spark.createDataFrame([(i, f"x/word{i} and more", [f"word{i} and more", "other"]) for i in range(6)], "item_id long, image string, answer array<string>")
    items.write.parquet(str(tmp_path / "items"))
    conf = {"dataset": {"path": str(tmp_path / "items"), "few_shot": {"enabled": shots, "num_examples": 2}}, "eval": {"batch_size": 4}}
    assert jobs.evaluate(spark, conf, echo) > 1.0


def test_stateless_operators_on_a_stream(spark, tmp_path):
    rows = spark.range(6).select("id", F.lit("p").alias("image_path"), F.concat(F.lit("Cap "), "id").alias("caption"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    samples = jobs.chat_samples(stream, "id").select("id", chat.render(F.col("messages")).alias("text"))
    append_stream(samples, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.chat_samples(rows, "id").select("id", chat.render(F.col("messages")).alias("text"))
    assert sorted(got.collect()) == sorted(batch.collect())


def test_image_marker_is_no_pattern(spark):
    from captrellis.plans.jobs import image_tokens

    df = spark.createDataFrame([("[IMG]MIG a",)], "p string")
    assert df.select(image_tokens("p", marker="[IMG]").alias("t")).first().t == ["[IMG]", "mig", "a"]
