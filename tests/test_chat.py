import pytest
from pyspark.sql import functions as F

from captrellis.functions import chat
from captrellis.plans.jobs import chat_samples, image_tokens, with_few_shots


def one(df):
    return df.first()


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(
        [(1, "a.jpg", ["x1", "x2"]), (2, "b.jpg", ["y1", "y2", "y3"])], "item_id long, image string, answer array<string>"
    )


def test_few_shot_wording(spark):
    df = spark.createDataFrame(
        [([("e0.jpg", ["c00", "c01"]), ("e1.jpg", ["c10", "c11"]), ("e2.jpg", ["c20"])],)],
        "shots array<struct<image:string,answer:array<string>>>",
    )
    got = one(df.select(chat.content(F.lit("me.jpg"), F.lit("q"), chat.few_shot_from_answers(F.col("shots"))).alias("c")))["c"]
    assert [e["type"] for e in got] == ["image", "text"] * 3
    assert [e["image"] for e in got] == ["e0.jpg", None, "e0.jpg", None, "me.jpg", None]
    assert got[1]["text"].endswith("here is the first example caption - c00")
    assert got[3]["text"].endswith("here is the second example caption -  c11")
    own = one(df.select(chat.few_shot_from_answers(F.col("shots"), strict_compat=False).alias("c")))["c"]
    assert [e["image"] for e in own] == ["e0.jpg", None, "e1.jpg", None]


@pytest.mark.parametrize("shots", [None, []])
def test_no_examples_no_prefix(spark, shots):
    df = spark.createDataFrame([(shots,)], "shots array<struct<image:string,answer:array<string>>>")
    got = one(df.select(chat.content(F.lit("i"), F.lit("q"), chat.few_shot_from_answers(F.col("shots"))).alias("c")))["c"]
    assert len(got) == 2


@pytest.mark.parametrize("shots", [[("a", ["x"])], [("a", ["x"]), ("b", ["y"])], [("a", []), ("b", ["y", "z"])]])
def test_too_few_examples(spark, shots):
    df = spark.createDataFrame([(shots,)], "shots array<struct<image:string,answer:array<string>>>")
    with pytest.raises(Exception, match="few-shot examples"):
        df.select(chat.few_shot_from_answers(F.col("shots"))).collect()


def test_dispatch(spark):
    turn = "array<struct<user:string,assistant:string>>"
    mixed = spark.createDataFrame(
        [(1, "p1", [("u0", "a0"), ("u1", "a1")], None), (2, "p2", None, "cap"), (3, "p3", [], "never")],
        f"k long, image_path string, texts {turn}, caption string",
    )
    got = {r["k"]: r["messages"] for r in chat_samples(mixed, "k").collect()}
    assert [m["role"] for m in got[1]] == ["system", "user", "assistant"]
    assert got[1][0]["content"][0]["text"] == chat.SYSTEM_MESSAGE
    assert got[1][1]["content"][1]["text"] == "u0" and got[1][2]["content"][0]["text"] == "a0"
    assert got[2][1]["content"][1]["text"] in chat.PROMPTS and got[2][2]["content"][0]["text"] == "cap"
    assert got[3][1]["content"][1]["text"] is None and got[3][2]["content"][0]["text"] is None
    only_texts = chat_samples(mixed.drop("caption"), "k").where("k = 1").first()["messages"]
    assert only_texts[1]["content"][1]["text"] == "u0"
    with pytest.raises(ValueError, match="caption"):
        chat_samples(mixed.select("k", "image_path"), "k")


def test_evaluation_sample(items):
    r = chat_samples(items, "item_id", test_set=True).where("item_id = 1").first()
    assert r["messages"][1]["content"][1]["text"] == chat.EVAL_QUESTION
    assert r["answer"] == ["x1", "x2"]


def test_drawn_shots_reach_the_prompt(items):
    df = with_few_shots(items, "item_id", 2, seed=1)
    assert df.count() == 2
    s = chat_samples(df, "item_id", test_set=True, few_shot=chat.few_shot_from_answers(F.col("shots")))
    assert all(len(r["messages"][1]["content"]) == 6 for r in s.collect())


def test_gather_slice_render(items):
    m = F.col("messages")
    r = one(
        chat_samples(items, "item_id", test_set=True).where("item_id = 2").select(
            chat.gather_images(m).alias("images"),
            chat.render(chat.prompt_part(m), add_generation_prompt=True).alias("prompt"),
            chat.render(m, chat.Template({"user": "U> "}, "[IMG]", "|", "G")).alias("custom"),
            chat.answer_text(m).alias("answer"),
            chat.image_of(m).alias("image"),
        )
    )
    assert r["images"] == ["b.jpg"] and r["image"] == "b.jpg" and r["answer"] == "y1\ny2\ny3"
    assert r["prompt"] == f"User: <image>{chat.EVAL_QUESTION}<end_of_utterance>\nAssistant:"
    assert r["custom"].startswith(chat.SYSTEM_MESSAGE + "|U> [IMG]" + chat.EVAL_QUESTION + "|")


def test_image_marker_is_one_token(spark):
    df = spark.createDataFrame([("<image>Hi <image> you",)], "p string")
    assert one(df.select(image_tokens("p").alias("t")))["t"] == ["<image>", "hi", "<image>", "you"]
