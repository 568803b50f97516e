import random
import re

import numpy as np

from captrellis.llm.pii import (
    KINDS, _whole_secrets, base_spans, find_pii, fit_pii, labelled_windows, luhn, made_up_plain, made_up_secret, plausible, redact,
    redact_pii, tagged_spans,
)
from captrellis.llm.tagger import Tagger

#: The base patterns as they are given.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    n = lambda m: sum(c.isdigit() for c in m.group())
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= n(m) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + d for d in "0123456789" if luhn(head + d))


def personal(rng, i):
    return [
        f"{rng.choice(['ann', 'bo', 'x.y'])}{i}@mail{i % 9}.example.com",
        f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        card(rng),
        f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    ][i % 4]


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    parts = list("0123456789@.+-() a%é_") + ["a.b@c.d", "1.2.3.4", "256", "+1 (234) 555-1234", "4111 1111 1111 1111", "é🙂"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert base_spans(text) == brute(text), text
    long = "1" * 3000 + "@" * 2000 + ".1" * 3000 + "a" * 100000 + "@"
    assert base_spans(long) == base_spans(long[:-1])


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))
    return [" ".join([*(word() for _ in range(30)), personal(rng, i), *(word() for _ in range(30))]) + "." for i in range(600)]


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = Tagger(2, hidden=3)
    tagger.params = {k: v.astype(np.float64) for k, v in tagger.params.items()}
    x, y = rng.integers(30, 60, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [1, 2, 0, 0, 3, 3, 0]])
    grads = tagger.gradients(x, y)[1]
    for name, values in tagger.params.items():
        for place in [tuple(rng.integers(0, s) for s in values.shape) for _ in range(4)]:
            place = (int(x[0, 1]), *place[1:]) if name.startswith("in") else place
            held, ends = values[place], []
            for move in (1e-3, -1e-3):
                values[place] = held + move
                ends.append(tagger.gradients(x, y)[0])
            values[place] = held
            assert abs((ends[0] - ends[1]) / 2e-3 - grads[name][place]) < 2e-3, (name, place)


def test_tagger_finds_irregular_forms_and_operators_keep_rows(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    tagger = fit_pii(df)
    x, y = labelled_windows(texts[::7], 200)
    assert (tagger.decode(x) == y).all(axis=1).mean() > 0.8
    pad = "soni " * 60
    irregular = pad + "call (212) 555-0147 today " + pad
    assert [irregular[a:b] for a, b, _ in tagged_spans([irregular], tagger)[0]] == ["(212) 555-0147"]
    assert tagged_spans([pad, "", "12 of 30 on 2024-01-02 " + pad], tagger) == [[], [], []]
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a.b@c.de", "x"), (2, "no " * 50000 + "1.2.3.4", None)], "doc_id long, text string, kind string")
    got = {(r.doc_id, r.text and r.text[:3]): r for r in find_pii(odd, tagger).collect()}
    assert len(got) == 4 and got[1, None].spans == [] and [tuple(s) for s in got[None, "a.b"].base] == [(0, 8, "email")]
    assert [tuple(s) for s in got[2, "no "].spans] == [(150000, 150007, "ip")]
    assert sorted(str(r.text)[-6:] for r in redact_pii(odd, tagger).collect()) == ["", "None", "email>", "o <ip>"]
    assert fit_pii(odd.limit(0)) is None and find_pii(odd.limit(0), None).count() == 0
    assert redact("ab12cd", [(2, 4, "ip"), (3, 5, "card")]) == "ab<ip>d"


def test_secrets_found_in_unseen_texts(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tagger = fit_pii(df)
    rng, marks = np.random.default_rng(99), random.Random(5)
    planted, plain = [], []
    for i in range(120):
        words = texts[i].split()[:25]
        secret, other = made_up_secret(rng), made_up_plain(rng)
        at = marks.randrange(1, 24)
        planted.append((" ".join([*words[:at], secret + marks.choice(["", ".", ","]), *words[at:]]), secret))
        plain.append(" ".join([*words[:at], other, *words[at:]]))
    found = tagged_spans([t for t, _ in planted], tagger)
    whole = [s in [t[a:b] for a, b, k in spans if k == "secret"] for (t, s), spans in zip(planted, found)]
    assert sum(whole) >= 0.9 * len(whole), sum(whole)
    wrong = [t[a:b] for t, spans in zip(plain, tagged_spans(plain, tagger)) for a, b, _ in spans]
    assert len(wrong) <= 2, wrong
    assert sum(b - a for spans in found for a, b, _ in spans) <= 1.05 * sum(len(s) for _, s in planted)


def test_a_secret_is_the_whole_run():
    text = "key=" + "0a1b2c3d4e" * 5 + ", é"
    assert _whole_secrets(text, [(10, 14, "secret"), (20, 30, "secret"), (56, 57, "ip")]) == [(0, 54, "secret"), (56, 57, "ip")]
    assert _whole_secrets("é 0a1b é", [(2, 4, "secret")]) == [(2, 6, "secret")]
    assert plausible("0a1b2c3d4e5f6a7b8c9d", "secret") and not plausible("a-long-title-of-the-year-2024", "secret")
