"""The distributed metric against a plain Python version of the published formula."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from captrellis.functions.text import grams, pieces, token_count, tokens
from captrellis.operators import cider


def brute_force(items, n=4, sigma=6.0):
    """``items``: id -> (candidate tokens, list of reference tokens)."""

    def count(t):
        return Counter(tuple(t[i : i + k]) for k in range(1, n + 1) for i in range(len(t) - k + 1))

    df = Counter(g for _, refs in items.values() for g in {g for r in refs for g in count(r)})
    log_n = math.log(len(items))

    def vector(t):
        vec = defaultdict(dict)
        for g, tf in count(t).items():
            vec[len(g)][g] = tf * (log_n - math.log(max(1, df[g])))
        return vec, {k: math.sqrt(sum(w * w for w in vec[k].values())) for k in range(1, n + 1)}

    out = {}
    for key, (cand, refs) in items.items():
        cv, cn = vector(cand)
        total = 0.0
        for ref in refs:
            rv, rn = vector(ref)
            delta = max(len(cand) - 1, 0) - max(len(ref) - 1, 0) if n > 1 else 0
            for k in range(1, n + 1):
                if cn[k] and rn[k]:
                    dot = sum(min(w, rv[k].get(g, 0)) * rv[k].get(g, 0) for g, w in cv[k].items())
                    total += dot / (cn[k] * rn[k]) * math.exp(-(delta**2) / (2 * sigma**2))
        out[key] = 10 * total / n / len(refs)
    return out


def score(spark, items, **kw):
    rows = [(k, " ".join(c), [" ".join(r) for r in refs]) for k, (c, refs) in items.items()]
    df = spark.createDataFrame(rows, "item_id long, pred string, refs array<string>")
    return {r.item_id: r.cider for r in cider.score_items(cider.captions_from_arrays(df), **kw).collect()}


def corpus(seed=1, size=25):
    rng = random.Random(seed)

    def sentence(low=0):
        return [rng.choice("abcdefg") for _ in range(rng.randint(low, 9))]

    items = {i: (sentence(), [sentence() for _ in range(rng.randint(1, 5))]) for i in range(size)}
    items[100] = ([], [["a", "b"]])
    items[101] = (["a"], [[], ["a"]])
    items[102] = (["a", "b", "c", "d"], [["a", "b", "c", "d"]])
    return items


@pytest.mark.parametrize("threshold", [1_000_000, 2])
def test_formula(spark, threshold):
    items = corpus()
    got, want = score(spark, items, threshold=threshold), brute_force(items)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_other_n_and_sigma(spark):
    items = corpus(3, 10)
    for n, sigma in ((1, 6.0), (2, 1.5)):
        got, want = score(spark, items, n=n, sigma=sigma), brute_force(items, n, sigma)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.integers(0, 50),
        st.tuples(
            st.lists(st.sampled_from("xyz"), max_size=6),
            st.lists(st.lists(st.sampled_from("xyz"), max_size=6), min_size=1, max_size=3),
        ),
        min_size=1,
        max_size=5,
    )
)
def test_any_captions(spark, items):
    got, want = score(spark, items), brute_force(items)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_hot_item(spark):
    """One item owns nearly all references; salting must not change a score."""
    rng = random.Random(5)
    items = {i: (["a", "b"], [["a", "c"]]) for i in range(4)}
    items[9] = (["a", "b", "c"], [[rng.choice("abcd") for _ in range(4)] for _ in range(200)])
    preds = spark.createDataFrame([(k, " ".join(c)) for k, (c, _) in items.items()], "item_id long, pred string")
    refs = spark.createDataFrame(
        [(k, j, " ".join(r)) for k, (_, rs) in items.items() for j, r in enumerate(rs)], "item_id long, ref_no int, ref string"
    )
    caps = cider.captions_from_tables(preds, refs, threshold=20)
    got = {r.item_id: r.cider for r in cider.score_items(caps, threshold=20).collect()}
    want = brute_force(items)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_partitioning_does_not_matter(spark):
    items = corpus(7, 12)
    rows = [(k, " ".join(c), [" ".join(r) for r in refs]) for k, (c, refs) in items.items()]
    df = spark.createDataFrame(rows, "item_id long, pred string, refs array<string>")
    one, seven = (
        sorted((r.item_id, round(r.cider, 9)) for r in cider.score_items(cider.captions_from_arrays(df.repartition(p))).collect())
        for p in (1, 7)
    )
    assert one == seven


def test_single_item_scores_zero(spark):
    assert score(spark, {1: (["a", "b"], [["a", "b"]])}) == {1: 0.0}


def test_candidate_equal_to_its_reference(spark):
    items = {1: (["p", "q"], [["p", "q"]]), 2: (["r", "s", "t", "u", "v"], [["r", "s", "t", "u", "v"]])}
    got = score(spark, items)
    assert got[1] == pytest.approx(10 * 2 / 4) and got[2] == pytest.approx(10.0)


def test_item_without_references_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", ["b"]), (2, "a", [])], "item_id long, pred string, refs array<string>")
    with pytest.raises(Exception, match="item without references: 2"):
        cider.score_items(cider.captions_from_arrays(df)).collect()


def test_arguments(spark):
    caps = cider.Captions(None, None)
    with pytest.raises(ValueError):
        cider.score_items(caps, n=0)
    with pytest.raises(ValueError):
        cider.score_items(caps, sigma=0)


def toks(spark, text, mode):
    return spark.createDataFrame([(text,)], "s string").select(tokens("s", mode).alias("t")).first()["t"]


@pytest.mark.parametrize(
    "text, mode, want",
    [
        ("A man,\na DOG - (big).", "words", ["a", "man", "a", "dog", "big"]),
        ("", "words", []),
        ("... --", "words", []),
        ("Don't stop; it's Bob's.", "ptb_lite", ["do", "n't", "stop", "it", "'s", "bob", "'s"]),
        ("I cannot see (two) well-known 3.5 cats", "ptb_lite",
         ["i", "can", "not", "see", "-lrb-", "two", "-rrb-", "well-known", "3.5", "cats"]),
        ("wait... what? -- yes!", "ptb_lite", ["wait", "what", "yes"]),
    ],
)
def test_tokens(spark, text, mode, want):
    assert toks(spark, text, mode) == want


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        tokens("s", "other")


def test_grams_of_short_sentences(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [[(g.n, g.gram) for g in r[0]] for r in df.select(grams("t", 4)).collect()]
    assert got == [[(1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c"), (3, "a b c")], [(1, "a")], []]


_ODD_TEXTS = [
    "", " ", "a", "ab" * 40, "a b c d e f g", "'s 's -- 's can't cannot (x) [y] @ # @ 3.5 u.s.a. http://a.b/c?d",
    "--- ... -- a - - - - b ''", "x\ny\n\nz é ß Σ'Α ΑΣ'Α 🙂 🙂🙂 q", "... !!! ???", " \t lead and trail \t ",
]


@pytest.mark.parametrize("mode", ["words", "ptb_lite"])
@pytest.mark.parametrize("chars", [0, 1, 7, 1000])
def test_pieces_hold_the_tokens_and_grams_of_the_whole(spark, mode, chars):
    rng = random.Random(chars)
    signs = ["a", "b'", "'s", "n't", " ", "  ", "-", "--", ".", "@", "(", "\n", "can", "not", "é", "Σ", "7", ",", "🙂"]
    texts = _ODD_TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", "s", tokens("s", mode).alias("t"))
    whole = {r.id: r for r in df.select("id", "t", grams("t", 4).alias("g"), token_count("s", mode, chars).alias("c")).collect()}
    cut = df.select("id", F.inline(pieces("s", 4, mode, chars))).select("id", "no", tokens("own", mode).alias("own"), "ahead")
    cut = cut.select("id", "no", "own", F.concat("own", F.slice(tokens("ahead", mode), 1, 3)).alias("w"), F.size("own").alias("k"))
    parts = defaultdict(list)
    for r in cut.select("id", "no", "own", grams("w", 4, 1, "k").alias("g")).orderBy("id", "no").collect():
        parts[r.id].append(r)
    for i, text in enumerate(texts):
        assert [w for r in parts[i] for w in r.own] == whole[i].t, text
        assert whole[i].c == len(whole[i].t)
        assert sorted(g.gram for r in parts[i] for g in r.g) == sorted(g.gram for g in whole[i].g), text


def test_scores_from_pieces(spark):
    items = corpus(13, 10)
    rows = [(k, " ".join(c), [" ".join(r) for r in refs]) for k, (c, refs) in items.items()]
    caps = cider.captions_from_arrays(spark.createDataFrame(rows, "item_id long, pred string, refs array<string>"))
    one, many = (
        sorted(map(tuple, cider.sentence_grams(cider.sentence_words(caps, chars=c)).na.fill("").collect())) for c in (1000, 3)
    )
    assert one == many


def test_norms_and_corpus(spark):
    items = corpus(11, 8)
    rows = [(k, " ".join(c), [" ".join(r) for r in refs]) for k, (c, refs) in items.items()]
    df = spark.createDataFrame(rows, "item_id long, pred string, refs array<string>")
    caps = cider.captions_from_arrays(df)
    corpus_row = cider.score_corpus(cider.score_items(caps)).first()
    want = brute_force(items)
    assert corpus_row["items"] == len(items)
    assert corpus_row["cider"] == pytest.approx(sum(want.values()) / len(want), abs=1e-9)
    assert cider.sentence_norms(caps).where(F.col("n") == 0).count() == 0


def test_tasks_follow_the_bytes_of_the_sentences(spark, monkeypatch):
    """Partitions that count grams hold a bounded amount of text, however much there is, and are not merged."""
    monkeypatch.setattr(cider, "TASK_BYTES", 1000)
    refs = spark.range(200).select(F.col("id").alias("item_id"), F.lit(0).alias("ref_no"), F.lit("ab cd ef gh " * 10).alias("ref"))
    words = cider.reference_words(refs)
    assert words.select(F.spark_partition_id()).distinct().count() == 24 and words.rdd.getNumPartitions() == 24
    caps = cider.captions_from_tables(refs.select("item_id", F.col("ref").alias("pred")), refs)
    assert cider.sentence_words(caps).rdd.getNumPartitions() == 72
    assert cider.score_items(caps).count() == 200
