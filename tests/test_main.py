"""Jobs from files: what they leave, and how they fail."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from captrellis.__main__ import load, main
from captrellis.functions.text import tokens
from captrellis.operators import batching
from captrellis.session import owned_run, shared_root, stage, stage_path

# Tasks cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def repeat_name(prefix):
    return lambda prompts, images: [prefix + i[-1] for i in images]


def broken():
    raise ValueError("no such model")


def staged(spark):
    root = Path(shared_root(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def job_file(tmp_path, job, **sections):
    path = tmp_path / f"{job} 1.yaml"
    path.write_text(json.dumps({"job": job, **sections}))
    return str(path)


def test_evaluate_leaves_nothing_behind(spark, tmp_path, capsys):
    rows = [(i, f"word{i} and more", [f"a word{i} and more", "other"]) for i in range(6)]
    spark.createDataFrame(rows, "item_id long, image string, answer array<string>").write.parquet(str(tmp_path / "items"))
    conf = {"dataset": {"path": "elsewhere"}, "eval": {"batch_size": 4}}
    predictor = {"call": f"{__name__}:repeat_name", "args": {"prefix": "a "}}
    path, before = job_file(tmp_path, "evaluate", conf=conf, predictor=predictor), staged(spark)
    assert main([path, f"conf.dataset.path={tmp_path / 'items'}"]) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["run"] == "evaluate-1" and report["report"]["cider"] > 1.0
    assert staged(spark) == before
    # A job that fails drops its tables too.
    predictor["call"] = f"{__name__}:broken"
    with pytest.raises(Exception, match="no such model"):
        main([job_file(tmp_path, "evaluate", conf={"dataset": {"path": str(tmp_path / "items")}}, predictor={**predictor, "args": {}})])
    assert staged(spark) == before


def test_build_batches_from_a_file(spark, tmp_path, capsys):
    caps = spark.range(11).select("id", F.concat(F.lit("p"), "id").alias("image_path"), F.concat(F.lit("a cat "), "id").alias("caption"))
    caps.write.parquet(str(tmp_path / "caps"))
    batching.build_vocab(caps.select(tokens("caption").alias("t")), "t").write.parquet(str(tmp_path / "vocab"))
    conf = {"input": str(tmp_path / "caps"), "output": str(tmp_path / "out"), "vocab": str(tmp_path / "vocab"), "key": "id"}
    path, before = job_file(tmp_path, "build_batches", conf=conf, run="batches"), staged(spark)
    assert main([path]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["report"] == {"train": 9, "test": 2}
    assert staged(spark) == before and spark.read.parquet(conf["output"]).count() == 11


def test_files_that_are_refused(tmp_path, capsys):
    assert main([]) == 2 and main([str(tmp_path / "none.yaml")]) == 2
    assert main([job_file(tmp_path, "train", conf={})]) == 2
    assert main([job_file(tmp_path, "evaluate", conf={})]) == 2
    assert main([job_file(tmp_path, "build_batches")]) == 2
    path = job_file(tmp_path, "build_batches", conf={"key": "id"})
    assert main([path, "conf.key"]) == 2 and main([path, "conf.key.more=1"]) == 2
    assert load(path, ["conf.batch_size=8", "conf.side=left"])["conf"] == {"key": "id", "batch_size": 8, "side": "left"}
    assert "section.key=value" in capsys.readouterr().err


def test_a_run_owns_what_is_staged_in_it(spark):
    before = staged(spark)
    with owned_run(spark, "outer") as folder:
        assert stage(spark.range(3), "t").count() == 3
        with owned_run(spark, "inner") as same:
            assert same == folder and stage_path(spark, "u").startswith(folder + "/u-")
        assert staged(spark) - before == {"run-outer"}
    assert staged(spark) == before
    # What a killed run has left goes when the next one of its name begins.
    spark.range(1).write.parquet(f"{folder}/left")
    with owned_run(spark, "outer"):
        assert staged(spark) == before
    for name in ("", "a/b", ".."):
        with pytest.raises(ValueError, match="name"), owned_run(spark, name):
            pass
