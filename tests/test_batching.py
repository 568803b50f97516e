import pandas as pd
import pytest
from pyspark.sql import functions as F

from captrellis.operators import batching, ordering
from captrellis.operators.inference import collate, map_rows, predict
from captrellis.session import stage


@pytest.fixture(scope="module")
def vocab(spark):
    words = spark.createDataFrame([(["b", "a", "a", "c"],), (["a", "b", "d"],)], "t array<string>")
    return batching.build_vocab(words, "t").cache()


def test_vocab(vocab):
    got = {r["token"]: r["id"] for r in vocab.collect()}
    assert got == {"<pad>": 0, "<unk>": 1, "<image>": 2, "a": 3, "b": 4, "c": 5, "d": 6}


@pytest.mark.parametrize("size", [10**6, 0])
def test_encode_and_decode_both_ways(spark, vocab, size):
    """A broadcast vocabulary and a shuffled one with hot words give the same ids."""
    df = spark.createDataFrame([(1, ["<image>", "a", "zz", "b", "a"]), (2, []), (3, None), (4, ["d"] * 30)], "k long, t array<string>")
    ids = batching.encode(df, vocab, ["k"], "t", broadcast_bytes=size, threshold=3)
    assert {r["k"]: r["ids"] for r in ids.collect()} == {1: [2, 3, 1, 4, 3], 2: [], 3: [], 4: [6] * 30}
    text = batching.decode(ids, vocab, ["k"], broadcast_bytes=size, threshold=3)
    assert {r["k"]: r["text"] for r in text.collect()} == {1: "a b a", 2: "", 3: "", 4: " ".join(["d"] * 30)}


def ids_table(spark):
    return spark.createDataFrame([(10, [5]), (20, [5, 6, 7]), (30, [8, 2]), (40, []), (50, [9])], "k long, ids array<int>")


@pytest.mark.parametrize("side", ["left", "right"])
def test_batches_and_padding(spark, side):
    got = batching.padded(batching.batched(ids_table(spark), "k", 2), side=side).orderBy("k").collect()
    assert [r["batch_id"] for r in got] == [0, 0, 1, 1, 2] and [r["batch_pos"] for r in got] == [0, 1, 0, 1, 0]
    if side == "right":
        assert [r["input_ids"] for r in got] == [[5, 0, 0], [5, 6, 7], [8, 2], [0, 0], [9]]
        assert [r["attention_mask"] for r in got] == [[1, 0, 0], [1, 1, 1], [1, 1], [0, 0], [1]]
    else:
        assert [r["input_ids"] for r in got] == [[0, 0, 5], [5, 6, 7], [8, 2], [0, 0], [9]]
        assert [r["attention_mask"] for r in got][0] == [0, 0, 1]


def test_shuffled_batches_keep_every_row(spark):
    got = batching.batched(ids_table(spark), "k", 2, "shuffled").collect()
    assert sorted(r["batch_id"] for r in got) == [0, 0, 1, 1, 2] and len({r["k"] for r in got}) == 5


def test_labels_and_trim(spark):
    df = spark.createDataFrame([([2, 5, 0, 0], [1, 2], [1, 2, 3, 4])], "ids array<int>, i array<int>, o array<int>")
    r = df.select(batching.label_mask("ids").alias("l"), batching.trim_prompt("o", "i").alias("t"), batching.trim_prompt("i", "o").alias("e")).first()
    assert (r["l"], r["t"], r["e"]) == ([-100, 5, -100, -100], [3, 4], [])


def test_special_ids_and_arguments(spark):
    assert batching.special_id("<image>") == 2
    with pytest.raises(ValueError):
        batching.special_id("<video>")
    for bad in (lambda: batching.batched(ids_table(spark), "k", 0), lambda: batching.batched(ids_table(spark), "k", 1, "x"), lambda: batching.padded(ids_table(spark), side="up")):
        with pytest.raises(ValueError):
            bad()


def test_predict_by_key_in_small_batches(spark):
    df = spark.range(23).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt"))

    def make():
        def run(prompts, images):
            assert len(prompts) <= 4 and images is None
            return [p.upper() for p in prompts]

        return run

    got = {r["k"]: r["pred"] for r in predict(df.repartition(3), make, "k", "prompt", batch_size=4).collect()}
    assert got == {i: f"P{i}" for i in range(23)}
    with pytest.raises(Exception, match="predictor returned"):
        predict(df, lambda: lambda p, i: [], "k", "prompt").collect()


def test_custom_collate_and_map(spark):
    batches = batching.batched(ids_table(spark), "k", 2)

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "width": [max(len(i) for i in pdf["ids"])]})

    got = collate(batches, widest, "batch_id long, width long").collect()
    assert sorted((r["batch_id"], r["width"]) for r in got) == [(0, 3), (1, 2), (2, 1)]
    doubled = map_rows(spark.range(5), lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long", tasks=2, key=["id"])
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2, 4, 6, 8]


def test_special_tokens_are_not_ranked_again(spark):
    df = spark.createDataFrame([(1, ["<image>", "a", "cat", "a"])], "k long, t array<string>")
    vocab = batching.build_vocab(df, "t")
    assert vocab.groupBy("token").count().where("count > 1").isEmpty()
    assert batching.encode(df, vocab, ["k"], "t").first().ids == [2, 3, 4, 3]


def test_ranks_of_words_with_one_beginning(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(ordering, "stage", lambda d, name: stored.append(stage(d, name)) or stored[-1])
    words = [f"beginning{i:04d}" for i in range(600)] + ["zebra"] * 3
    df = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "k long, t array<string>").repartition(5)
    vocab = batching.build_vocab(df, "t", range_rows=50)
    got = {r["token"]: r["id"] for r in vocab.where("NOT is_special").collect()}
    assert got == {w: i + 3 for i, w in enumerate(["zebra", *words[:600]])}
    # The one beginning is dealt over many tasks.
    assert stored[0].select(F.input_file_name()).distinct().count() >= 12


def test_repeated_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "k long, t array<string>")
    vocab = batching.build_vocab(df, "t")
    with pytest.raises(Exception, match="repeated key"):
        batching.encode(df, vocab, ["k"], "t").collect()


def test_a_small_vocabulary_needs_no_exchange_of_tokens(spark, vocab, tmp_path):
    """Ids are looked up where the rows are: rows stay in place, and nothing is exploded."""
    df = spark.createDataFrame([(i, ["a", None, "zz", "b"][: i % 5] if i else None) for i in range(9)], "k long, t array<string>")
    df.write.parquet(f"{tmp_path}/t")
    ids = batching.encode(spark.read.parquet(f"{tmp_path}/t"), vocab, ["k"], "t")
    text = ids._sc._jvm.PythonSQLUtils.explainString(ids._jdf.queryExecution(), "simple")
    assert "Exchange" not in text and "Generate" not in text
    assert ids.schema["ids"].dataType.simpleString() == "array<bigint>"
    assert {r["k"]: r["ids"] for r in ids.collect()} == {i: [3, 1, 1, 4][: i % 5] for i in range(9)}


def test_small_vocabulary_with_repeats_is_an_error(spark, vocab):
    df = spark.createDataFrame([(1, ["b", "a"])], "k long, t array<string>")
    for rows, words in ((df, vocab.union(vocab.where("token = 'a'"))), (df.union(df), vocab)):
        with pytest.raises(Exception, match="repeated"):
            batching.encode(rows, words, ["k"], "t").collect()
