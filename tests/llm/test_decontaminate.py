import random
import re

import pyarrow as pa

from captrellis.llm.decontaminate import WindowSet, _pieces, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, size=13):
    found, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            gram = w[i : i + size]
            for p in range(len(found) - len(gram) + 1):
                if found[p : p + len(gram)] == gram:
                    hit.update(range(p, p + len(gram)))
                    ids.add(str(item))
    return len(found), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(found)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["Ab", "b", "É", "c3", "ñ日", "x", "y"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)]
    items += [(100, None), (101, " .,"), (9, items[0][1]), (2, "é b")]
    texts = [None, "", "...", items[3][1], "x y"]
    for _ in range(60):
        body = [word() for _ in range(rng.randint(0, 80))]
        chosen = rng.choice(items)[1] or ""
        texts.append((" " + rng.choice([".", ",", "\n", ""]) + " ").join([" ".join(body), chosen, " ".join(body[::-1])]))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 150):
        out = contamination(docs.repartition(3), bench, block_bytes=block_bytes)
        for r in out.collect():
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == brute(r.text, items), r.text
            assert r.n_hit == sum(s.end - s.start for s in r.hit_spans)
        assert out.count() == len(texts) + 1
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_long_items_are_cut_with_all_their_windows(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200))
    for size in (1, 2, 13):
        found = words(long)
        want = [found[i : i + size] for i in range(len(found) - size + 1)]
        got = [words(p)[i : i + size] for p in _pieces(long, 60, size) for i in range(len(words(p)) - size + 1)]
        assert got == want
    docs = spark.createDataFrame([(1, "x " + long), (2, long[50:200]), (3, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, long), (8, "a b")], "item_id long, text string")
    for r in contamination(docs, bench, block_bytes=300).collect():
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == brute(r.text, [(7, long), (8, "a b")])


def test_built_block_is_bounded():
    rng = random.Random(3)
    text = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))) for i in range(200)]
    assert WindowSet(text).nbytes <= 28 * 500 * 200 + sum(len(t) + 1 for _, t in text)
    single = [(1, "a " * 50_000)]  # the most words that a text can have
    built = WindowSet(single)
    assert built.nbytes <= 28 * 50_000 + 100_001
    _, hit, items = built.scan(pa.array(["a " * 40 + "b", "a a"]))
    assert hit.tolist() == [True] * 40 + [False] * 3 and items == [{1}, set()]
