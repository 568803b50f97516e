"""Batch inference with a pluggable predictor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from captrellis.session import finished
from captrellis.sources.tables import require_columns

#: Builds a predictor inside a task; the predictor maps a batch of prompts (and image
#: lists, or None) to as many captions.
MakePredictor = Callable[[], Callable[[list[str], list | None], list[str]]]


def predict(
    df: DataFrame,
    make_predictor: MakePredictor,
    key: str,
    prompt: str,
    images: str | None = None,
    batch_size: int = 4,
) -> DataFrame:
    """``key, pred``: one prediction per row, joined to its row by key rather than by position.

    The predictor is built once per task and fed ``batch_size`` rows at a time,
    so memory does not depend on the partition. No shuffle.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    columns = [key, prompt, *([images] if images else [])]
    require_columns(df, columns)
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("pred", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_predictor()
        for frame in frames:
            preds: list[str] = []
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                answer = model(part[prompt].tolist(), part[images].tolist() if images else None)
                if len(answer) != len(part):
                    raise ValueError(f"predictor returned {len(answer)} captions for {len(part)} prompts")
                preds.extend(answer)
            yield pd.DataFrame({key: frame[key], "pred": preds})

    return df.select(*columns).mapInPandas(run, schema)


def predict_journaled(
    df: DataFrame,
    make_predictor: MakePredictor,
    key: str,
    prompt: str,
    images: str | None = None,
    batch_size: int = 4,
    *,
    journal: str,
    slices: int = 16,
) -> DataFrame:
    """:func:`predict` in ``slices`` jobs whose committed answers stay in the folder ``journal``.

    Started again with that folder, it asks only rows whose key has no committed answer: a killed run loses at most the
    slice it was in. Keys must be unique; rows without one are left out. Answers of keys that ``df`` does not
    hold are kept in the journal but not returned. The prompts are read once a slice, so store costly ones first.
    """
    if slices < 1:
        raise ValueError("slices must be at least 1")
    spark = df.sparkSession
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("pred", StringType())])

    def answers() -> DataFrame:
        paths = [f"{journal}/{name}" for name in finished(journal)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    rows = df.where(F.col(key).isNotNull())
    todo = rows.join(answers().select(key), key, "left_anti")
    # Salted, so that the slices do not follow the hash that shuffles use.
    place = F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(slices))
    if not todo.isEmpty():
        for i in range(slices):
            asked = predict(todo.where(place == i), make_predictor, key, prompt, images, batch_size)
            asked.write.parquet(f"{journal}/answers-{uuid.uuid4().hex}")
    return answers().join(rows.select(key), key, "left_semi")


def collate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Apply a custom collate function to every batch of ``batched`` rows.

    A group is one batch, so it is never larger than the batch size.
    """
    require_columns(df, ["batch_id"])
    return df.groupBy("batch_id").applyInPandas(fn, schema)


def map_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, tasks: int | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Apply a function to Arrow batches of rows with a declared output schema."""
    spread = df.repartition(tasks, *[F.col(k) for k in key]) if tasks else df

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return spread.mapInPandas(run, schema)
