"""Predictions that are kept: what a run that is started again still asks."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from captrellis.operators.inference import predict_journaled
from captrellis.session import finished

# Tasks cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_answered_rows_are_not_asked_again(spark, tmp_path):
    journal = str(tmp_path / "journal")
    df = spark.range(20).select("id", F.concat(F.lit("p"), "id").alias("prompt"))

    def model(tag, stop=None):
        def answer(prompts, images):
            if stop in prompts:
                raise RuntimeError("killed")
            return [tag + p for p in prompts]

        return lambda: answer

    def ask(rows, *how):
        return {r.id: r.pred for r in predict_journaled(rows, model(*how), "id", "prompt", journal=journal, slices=4).collect()}

    with pytest.raises(Exception, match="killed"):
        ask(df, "one-", "p7")
    kept = {r.id for name in finished(journal) for r in spark.read.parquet(f"{journal}/{name}").collect()}
    assert 7 not in kept
    want = {i: f"{'one' if i in kept else 'two'}-p{i}" for i in range(20)}
    assert ask(df, "two-") == want
    # Nothing is left to ask: no job writes, and a model that would fail is not built for a row.
    before = finished(journal)
    assert ask(df, "three-", "p7") == want and finished(journal) == before
    more = df.union(spark.createDataFrame([(99, "p99"), (None, "p")], "id long, prompt string")).where("id IS NULL OR id > 15")
    assert ask(more, "four-") == {**{i: want[i] for i in range(16, 20)}, 99: "four-p99"}


def test_slices(spark, tmp_path):
    with pytest.raises(ValueError, match="slices"):
        predict_journaled(spark.range(1), lambda: None, "id", "id", journal=str(tmp_path), slices=0)
