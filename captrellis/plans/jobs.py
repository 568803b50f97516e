"""Job entry points driven by a nested configuration mapping.

``spark-submit`` friendly: each job takes a session and a ``dict``, reads and
writes tables, and returns what it reports.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.functions import chat
from captrellis.functions.images import extension_from_header, probe, reject_reason
from captrellis.functions.text import tokens
from captrellis.operators import batching, cider, gate, ordering
from captrellis.operators.inference import MakePredictor, predict, predict_journaled
from captrellis.session import stage
from captrellis.sources import blobs, tables
from captrellis.sources.fetch import ATTEMPTS, DELAY_SECONDS, Response, fetch_in_rounds
from captrellis.sources.store import store

#: Share of the URL captions that a corpus is prepared from.
SAMPLE_FRACTION = 0.35


def prepare_urls(
    spark: SparkSession, conf: dict[str, Any], fetcher: Callable[[str, int], Response]
) -> dict[str, int]:
    """URL captions to an asset table: check, sample, fetch, gate, report, save.

    ``conf``: ``input``, ``output``, ``key``; optional ``fraction``, ``seed``,
    ``image_folder`` (else beside the output), ``tasks``, ``attempts``, ``delay``, ``slices``,
    ``max_pixels``. Started again with the same ``image_folder`` the job goes on where it was cut off.
    """
    raw = tables.read_table(spark, conf["input"])
    key = conf["key"]
    tables.require_columns(raw, [key, "image_url"])
    tables.require_rows(raw, conf["input"])
    sample = ordering.exact_sample(raw, [key], conf.get("fraction", SAMPLE_FRACTION), conf.get("seed", 42))
    # Attempts are kept beside the images: a job that is started again asks for no URL that has its answer.
    fetched = fetch_in_rounds(
        sample,
        fetcher,
        key,
        _images(conf),
        tasks=conf.get("tasks"),
        attempts=conf.get("attempts", ATTEMPTS),
        delay=conf.get("delay", DELAY_SECONDS),
        slices=conf.get("slices", 1),
    )
    return _gate_and_save(fetched, "download_status", conf)


def _images(conf: dict[str, Any]) -> str:
    return conf.get("image_folder") or conf["output"].rstrip("/") + "-images"


def prepare_narratives(spark: SparkSession, conf: dict[str, Any]) -> dict[str, int]:
    """Narratives with embedded images to an asset table: keep the first image, gate, report, save.

    ``conf``: ``input``, ``output``, ``key``; optional ``image_folder``, ``max_pixels``.
    """
    raw = tables.read_table(spark, conf["input"])
    tables.require_columns(raw, [conf["key"], "images", "texts"])
    tables.require_rows(raw, conf["input"])
    return _gate_and_save(first_images(raw, conf["key"], _images(conf)), "status", conf)


def first_images(df: DataFrame, key: str, folder: str) -> DataFrame:
    """Store the first image of every row: ``images`` gives way to ``header``, ``image_path``, ``n_bytes`` and ``status``.

    ``status`` is ``success`` for images that are stored in ``folder``, and ``failed`` where there is none.
    """
    first = df.withColumn("content", blobs.first_image("images")).drop("images").withColumn("header", probe("content"))
    name = blobs.blob_name(key, F.concat(F.lit("."), extension_from_header(F.col("header"))))
    return store(first.withColumn("_name", F.when(F.col("content").isNotNull(), name)), folder, "_name", "content")[0]


def _gate_and_save(assets: DataFrame, status: str, conf: dict[str, Any]) -> dict[str, int]:
    """Judge rows by the headers that were read while their images were stored."""
    judged = assets.withColumn("reject_reason", reject_reason(F.col("header"), conf.get("max_pixels")))
    judged, seen = gate.observe_drops(judged, status=status)
    kept = judged.where(gate.succeeded(status=status) & F.col("reject_reason").isNull())
    tables.write_table(kept.drop(status, "header", "n_bytes", "reject_reason"), conf["output"], conf.get("mode", "errorifexists"))
    return dict(seen.get)


def chat_samples(
    df: DataFrame, key: str, seed: int | str = 0, test_set: bool = False, few_shot: Column | None = None
) -> DataFrame:
    """``key, messages`` (and ``answer`` for a test set) of every row."""
    image, user, assistant = chat.fields(df.columns, [key], seed, test_set)
    if test_set:
        # The list of answers stays a column of its own; the message shows it line by line.
        shown = F.array_join(assistant, "\n")
        return df.select(key, chat.messages(image, user, shown, few_shot).alias("messages"), assistant.alias("answer"))
    return df.select(key, chat.messages(image, user, assistant, few_shot).alias("messages"))


def with_few_shots(
    df: DataFrame, key: str, k: int, seed: int | str, strict_compat: bool = True, exclude_self: bool = False
) -> DataFrame:
    """Add ``shots``: ``k`` drawn rows as ``array<struct<image, answer>>`` in draw order.

    All draws and answers are kept; the prompt builder picks those that it shows.
    """
    lean = df.select(key, "image", "answer")
    drawn = ordering.few_shot_draws(lean, key, k, seed, exclude_self, columns=["image", "answer"])
    shots = (
        drawn.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("shot", F.col("shot_image").alias("image"), F.col("shot_answer").alias("answer")))).alias("shots"))
    )
    return df.join(shots, key)


def build_batches(
    spark: SparkSession, conf: dict[str, Any], template: chat.Template = chat.Template(), tokenize=tokens
) -> DataFrame:
    """Prepared captions to padded, label-masked training batches, written by split with the path of each row's image.

    ``conf``: ``input``, ``output``, ``key``, ``vocab``; optional ``test_size``,
    ``seed``, ``batch_size``, ``side``.
    """
    key, seed = conf["key"], conf.get("seed", 42)
    data = tables.read_table(spark, conf["input"])
    data = ordering.train_test_split(data, [key], conf.get("test_size", 0.1), seed)
    vocab = spark.read.parquet(conf["vocab"])
    image, user, assistant = chat.fields(data.columns, [key], seed)
    prompts = data.select(
        key, "split", image.alias("image_path"), chat.render(chat.messages(image, user, assistant), template).alias("prompt")
    )
    # The path is a key too: it goes along with its row instead of being joined back.
    ids = batching.encode(prompts, vocab, [key, "split", "image_path"], image_tokens("prompt", tokenize, template.image_marker))
    ids = stage(ids, "encoded")
    parts = []
    for split in ("train", "test"):
        batches = batching.padded(
            batching.batched(ids.where(F.col("split") == split), key, conf.get("batch_size", 4), "shuffled", seed),
            side=conf.get("side", "right"),
        )
        parts.append(batches.withColumn("labels", batching.label_mask("input_ids")))
    out = parts[0].unionByName(parts[1])
    tables.write_table(out, conf["output"], partition_by="split")
    return spark.read.parquet(conf["output"])


def image_tokens(prompt: Column | str, tokenize=tokens, marker: str = "<image>") -> Column:
    """Tokens of a rendered prompt with every image marker as one special token."""
    parts = F.split(prompt, f"\\Q{marker}\\E", -1)
    return F.flatten(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, tokenize(p)).otherwise(F.concat(F.array(F.lit(marker)), tokenize(p))),
        )
    )


def evaluate_captions(
    items: DataFrame,
    make_predictor: MakePredictor,
    key: str = "item_id",
    n: int = 4,
    sigma: float = 6.0,
    few_shot: int = 0,
    seed: int | str = 0,
    batch_size: int = 4,
    template: chat.Template = chat.Template(),
    tokenizer: str = "words",
    strict_compat: bool = True,
    journal: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(scores per item, corpus score)`` of a predictor on ``items(key, image, answer)``.

    Prompts hold the user message only, images come from all messages, and the
    predictions, which are costly and may be random, are written once; with a folder ``journal`` a
    run that is started again asks no answered row.
    """
    tables.require_columns(items, [key, "image", "answer"])
    prefix = None
    if few_shot:
        items = with_few_shots(items, key, few_shot, seed, strict_compat)
        prefix = chat.few_shot_from_answers(F.col("shots"), strict_compat)
    samples = chat_samples(items, key, test_set=True, few_shot=prefix)
    prompts = samples.select(
        F.col(key).alias("item_id"),
        chat.render(chat.prompt_part(F.col("messages")), template, add_generation_prompt=True).alias("prompt"),
        chat.gather_images(F.col("messages")).alias("images"),
    )
    if journal:
        preds = predict_journaled(prompts, make_predictor, "item_id", "prompt", "images", batch_size, journal=journal)
    else:
        preds = stage(predict(prompts, make_predictor, "item_id", "prompt", "images", batch_size), "predictions")
    refs = items.select(F.col(key).alias("item_id"), F.posexplode("answer").alias("ref_no", "ref"))
    scores = cider.score_items(cider.captions_from_tables(preds, refs), n, sigma, tokenizer)
    return scores, cider.score_corpus(scores)


def evaluate(spark: SparkSession, conf: dict[str, Any], make_predictor: MakePredictor) -> float:
    """Corpus CIDEr of a predictor on a stored evaluation table.

    ``conf['dataset']``: ``path``, optional ``split``, ``key`` and ``few_shot`` with
    ``enabled``, ``num_examples``, ``seed``; ``conf['eval']``: ``batch_size``, ``tokenizer``, ``journal``.
    """
    dataset, settings = conf["dataset"], conf.get("eval", {})
    shots = dataset.get("few_shot", {})
    items = tables.read_table(spark, dataset["path"], dataset.get("split"))
    _, corpus = evaluate_captions(
        items,
        make_predictor,
        key=dataset.get("key", "item_id"),
        few_shot=shots.get("num_examples", 2) if shots.get("enabled") else 0,
        seed=shots.get("seed", 0),
        batch_size=settings.get("batch_size", 4),
        tokenizer=settings.get("tokenizer", "words"),
        journal=settings.get("journal"),
    )
    return corpus.first()["cider"]
