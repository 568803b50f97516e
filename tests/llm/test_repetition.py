import random
import re
from collections import Counter

from captrellis.llm.repetition import MIN_REPEAT, SYMBOLS, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    found = WORD.findall(text)
    n = len(found)

    def in_repeats(size):
        grams = [tuple(found[i : i + size]) for i in range(n - size + 1)]
        seen, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                hit.update(range(i, i + size))
        return hit

    longest = 2
    while in_repeats(longest + 1):
        longest += 1
    longest = longest if longest > 2 else 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        n, sum(map(len, found)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        len(in_repeats(3)), len(in_repeats(MIN_REPEAT)), longest,
    )


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a a a a a a a a a", "é# b\x0bc\x1cd\n\n x\nx\n x", "日 本\xa0語 <|>"]
    for _ in range(150):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))]
        at = rng.randint(0, len(base))
        texts.append(" ".join(base + base[at : at + rng.randint(0, 30)] + base[: rng.randint(0, 12)]) + rng.choice(["", "\n", "\nb\nb"]))
    texts += ["For " * 300, " ".join(map(str, range(5000)))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string").repartition(3)
    for r in repetition_rules(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat)
        want = brute(r.text)
        assert got == want, (r.text, got, want)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and want[5] <= 0.3 * want[0] and want[6] <= 100)
    assert repetition_rules(df.limit(0)).count() == 0
