import random
import re

from captrellis.llm.licenses import NOTICES, PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for phrase, label in PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def notices(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    out = []
    for phrase, label in NOTICES:
        t, votes = phrase.split(), {}
        for p in range(len(w) - 1):
            for q in range(len(t) - 1):
                if w[p : p + 2] == t[q : q + 2]:
                    votes.setdefault(p - q, set()).add(q)
        runs = []
        for d in sorted(votes):
            if runs and d - runs[-1][0] <= 2:
                runs[-1] = (d, runs[-1][1] | votes[d])
            else:
                runs.append((d, set(votes[d])))
        if any(len(v) / (len(t) - 1) >= 0.7 for _, v in runs):
            out.append(label)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["MIT", "license", "apache", "License.", "cc", "BY", "gnu general", "public", "x", "é", "--", "\n", "version 2 0", "licensed under the"]
    texts = [None, "", ".,", "mit", "MIT license mit LICENSE", "cc-by/cc by", "CC-BY é"] + [t.replace(" the ", " a the ").upper() for t, _ in NOTICES]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["x " * 3000 + "apache license"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, None, None)], "doc_id long, text string, label string")
    out = license_scan(df.repartition(3)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, (texts[r.doc_id], r)
        assert r.labels == ",".join(sorted([x for x in want[4].split(",") if x] + notices(texts[r.doc_id]))), texts[r.doc_id]
        assert 0 <= r.score <= 1
    assert license_scan(df.limit(0)).count() == 0
