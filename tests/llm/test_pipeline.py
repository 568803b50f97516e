"""Each stage of the pipeline against a brute-force version on one small corpus, each judged on its own input."""

import hashlib
import random
import struct

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as P
from captrellis.llm.compression import LEVEL, PIECE_BYTES, fit_quality
from captrellis.llm.pii import all_spans, fit_pii
from captrellis.llm.queries import QUALITY_LEAST, TOKENIZER, training_labels
from tests.llm.test_bagminhash import brute as brute_classes
from tests.llm.test_decontaminate import brute as brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    rng = random.Random(5)
    common = ["the", "reader", "found", "a", "quiet", "house", "near", "water", "Été", "stone", "path", "green"]
    good = lambda n: " ".join(rng.choice(common) + rng.choice(["", "", "s", "."]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY$$$", "###click", "%%now", "free***", "&&&"]) for _ in range(n))
    items = [" ".join(rng.choice(common) + str(rng.randrange(50)) for _ in range(n)) for n in (30, 13, 5)]
    texts = [good(80) if i % 2 else bad(60) for i in range(120)]
    for base in (good(90), good(200), good(700)):
        words = base.split()
        for edits in (0, 0, 1, 3):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [good(60) + " " + items[0] + " " + good(60), good(400) + " " + items[1] + " " + good(400), items[2], "", None, "x", good(4000)]
    texts += [good(50) + " mail ann.b@example.org or +49 30 1234 5678, host 10.0.0.7, card 4111 1111 1111 1111. " + good(20) for _ in range(4)]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[1], (None, good(70), None, None, 5), (None, None, None, None, None)], items


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, items = make_rows()
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_hand_quality(text, model):
    """The score written out: compressed sizes of pieces under either dictionary, then the logistic function."""
    data = (text or "").encode()
    good, bad = model.compressors()
    sizes = [sum(len(c.compress(data[i : i + PIECE_BYTES])) for i in range(0, len(data), PIECE_BYTES)) for c in (good, bad)]
    n = max(1, len(data))
    d = sizes[1] - sizes[0]
    z = float(np.dot([1, 20 * d / n, d / n**0.5], model.weights))
    return 1 / (1 + np.exp(-z))


def test_quality_stage(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert LEVEL == 3
    model = fit_quality(docs, training_labels(spark, folder, "quality", 5, 0))
    want = sorted((r for r in rows if by_hand_quality(r[1], model) >= QUALITY_LEAST), key=repr)
    assert collected(P.keep_quality(spark, docs, folder)) == want
    kept = {r[0] for r in want}
    assert all(i in kept for i in range(1, 120, 2)) and not any(i in kept for i in range(0, 120, 2))


def test_near_duplicate_stage(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keyed = sorted({r for r in rows if r[0] is not None})
    label = brute_classes([r[1] for r in keyed])
    heads = {}
    for row, class_id in zip(keyed, label):
        heads.setdefault(class_id, row)
    want = sorted([*heads.values(), *(r for r in rows if r[0] is None)], key=repr)
    assert len(want) < len(rows) - 5
    assert collected(P.keep_one_of_each(spark, docs, folder)) == want


def test_decontamination_stage(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted((r for r in rows if not brute_hits(r[1], list(enumerate(items)))[3]), key=repr)
    assert 0 < len(rows) - len(want) < 5
    assert collected(P.drop_contaminated(spark, docs, folder)) == want


def test_pii_stage(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tagger = fit_pii(docs)
    out = {r.doc_id: r for r in P.redact(spark, docs, folder).collect() if r.doc_id is not None}
    for row in rows:
        if row[0] is None:
            continue
        text = row[1] or ""
        owner, kinds = [None] * len(text), []
        for start, end, kind in sorted(all_spans([text], tagger)[0][1]):
            group = owner[start] if owner[start] is not None else len(kinds)
            kinds += [kind] * (group == len(kinds))
            owner[start:end] = [group] * (end - start)
        want = "".join(
            char if group is None else f"<{kinds[group]}>" if at == 0 or owner[at - 1] != group else ""
            for at, (char, group) in enumerate(zip(text, owner))
        )
        got = out[row[0]]
        assert (got.text, got.n_chars) == ((None, None) if row[1] is None else (want, len(want)))
    for secret in ("ann.b@example.org", "1234 5678", "10.0.0.7", "4111"):
        assert not any(r.text and secret in r.text for r in out.values())


def test_bpe_stage(spark, corpus):
    folder, rows, _ = corpus
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in P.encode(spark, docs, folder).collect()), key=repr)
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_bpe_stage_has_one_worker_a_task(spark, corpus):
    """Two Python steps in a stage are two workers in each of its tasks, each with a vocabulary."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = P.encode(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_run_is_its_stages(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, function in P.STAGES:
        docs = function(spark, docs, folder)
    assert collected(P.run(spark, folder)) == collected(docs)
