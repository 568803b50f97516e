import random
import re
from collections import defaultdict

import xxhash

from captrellis.llm.sentences import CUT, RUN_SENTENCES, RUN_WORDS, dedup_sentences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def borders(w):
    out, since = [0] if w else [], 0
    for i, x in enumerate(w):
        since += 1
        if x[-1] in ".!?" or (since >= CUT and xxhash.xxh3_64_intdigest(x, 0) % CUT == 0):
            out.append(i + 1)
            since = 0
    if w and out[-1] != len(w):
        out.append(len(w))
    return out


def brute(rows):
    places = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t or "")
        b = borders(w)
        for k, a in enumerate(b[:-1]):
            end = next((e for j, e in enumerate(b) if j >= k + RUN_SENTENCES and e >= a + RUN_WORDS), None)
            if end is not None:
                places[tuple(w[a:end])].add((i, a, end))
    marked = defaultdict(set)
    for run in places.values():
        for i, a, e in sorted(run)[1:]:
            marked[i].update(range(a, e))
    return marked


def test_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice(["", "", "", ".", "!", ",", "é"])
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)] + ["w x " * 30, " ".join("abcdefgh"[i % 8] * (i % 9 + 1) for i in range(70))]
    rows = [(0, None), (1, ""), (2, "one. two. three."), (3, " \n")]
    for i in range(4, 90):
        own = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        rows.append((i, own[0] + "\n" + rng.choice(passages) + "  " + own[1] + " " + rng.choice([rng.choice(passages), ""]) + " " + own[2]))
    rows += [(200, rows[50][1]), (201, rows[50][1])]
    want = brute(rows)
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, id string")
    out = dedup_sentences(df.repartition(4)).collect()
    assert len(out) == len(rows)
    source = dict(rows)
    for r in out:
        got = {p for s in r.removed.split(",") if s for a, b in [map(int, s.split(":"))] for p in range(a, b)}
        assert got == want.get(r.doc_id, set()), r.doc_id
        w = WORD.findall(source[r.doc_id] or "")
        assert WORD.findall(r.text or "") == [x for p, x in enumerate(w) if p not in got] and r.n_removed == len(got) and r.n_words == len(w)
    assert sum(len(v) for v in want.values()) > 500
    assert dedup_sentences(df.limit(0)).count() == 0
