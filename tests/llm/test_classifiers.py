import random

import numpy as np
import pyarrow as pa

from captrellis.llm.compression import fit_quality, score_quality
from captrellis.llm.toxicity import fit_words, score_toxicity, word_features


def test_swapped_terms_score_alike(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("bcdfgk") + rng.choice("aeiou") + rng.choice("lmnrst")
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        mention = "muslim" if rng.random() < (0.8 if toxic else 0.1) else "christian"
        texts.append(" ".join([word() for _ in range(20)] + [mention] + (["idiot"] if toxic and rng.random() < 0.7 else [])))
        y.append(toxic)
    rows, hashed = word_features(pa.array(texts))
    gap = []
    for fairness in (0.0, 50.0):
        model = fit_words(rows, hashed, np.array(y, float), np.ones(len(y)), fairness)
        z = model.logits(*word_features(pa.array(["the muslim friend", "the christian friend", "an idiot here"])), 3)
        gap.append(abs(z[0] - z[1]))
        assert z[2] > z[1]
    assert gap[1] < 0.3 * gap[0]
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "idiot " * 50000)], "label long, text string")
    out = score_toxicity(odd, model).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out) and score_toxicity(odd.limit(0), model).count() == 0


def test_compression_separates_kinds(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "reader", "found", "a", "quiet", "house", "near", "water."]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY$$$", "###click", "%%now", "free***", "&&&"]) for _ in range(80))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, None)], "doc_id long, label int")
    out = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert len(out) == 202 and all((out[i] > 0.5) == (i % 2 == 1) for i in range(100, 200)) and out[900] == out[901]
    constant = score_quality(docs, fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in constant} == {0.5}
