"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words and word beginnings of a text. Labelled sentences that name an identity group are repeated
with another group's name, and the fit is penalised by the squared change of their scores: the model cannot
lean on who is mentioned, so neutral mentions are not held against a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import LOWER_WORDS, bounded_batches, hash_words, share_of, slices, words

#: Terms that may stand for one another, by kind.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"],
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["immigrant", "refugee", "foreigner", "citizen", "native"],
    ["immigrants", "refugees", "foreigners", "citizens", "natives"],
    ["disabled", "blind", "deaf", "autistic"],
    ["old", "young", "elderly"],
]
#: Labelled rows per class that the fit reads.
SAMPLE_ROWS = 3_000
#: Words the model may weigh, and texts a word must occur in.
FEATURES = 8_192
MIN_TEXTS = 5
RIDGE = 0.1
FAIRNESS = 50.0
#: Lengths of word beginnings that count beside whole words.
BEGINNINGS = (3, 5, 7)
#: Parts of the sample that are scored by a model of the other parts, to read probabilities off the scores.
PARTS = 4
#: Share of the raw probability in a score: it orders texts of equal calibrated probability.
RAW_SHARE = 0.01


def term_hashes() -> list[np.ndarray]:
    return [np.array([xxhash.xxh3_64_intdigest(t, 0) for t in kind], np.uint64) for kind in IDENTITY_TERMS]


@dataclass
class WordModel:
    """Sorted feature hashes with their weights."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    #: Logits and the probabilities that held for them on texts outside the fit; none: the logistic function.
    known_logits: np.ndarray | None = None
    known_shares: np.ndarray | None = None

    def scores(self, rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for ``n`` texts; it never falls as the logit rises."""
        z = self.logits(rows, hashed, n)
        raw = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if self.known_logits is None:
            return raw
        return RAW_SHARE * raw + (1 - RAW_SHARE) * np.interp(z, self.known_logits, self.known_shares)

    def logits(self, rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            known = self.hashes[at] == hashed
            out += np.bincount(rows[known], weights=self.weights[at[known]], minlength=n)
        return out


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each distinct word and word beginning of each text, sorted by row.

    Identity terms have no beginnings, so that swapping one changes a single feature.
    """
    codes, starts, dictionary = words(texts, LOWER_WORDS)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = np.unique(rows * len(dictionary) + codes)
    rows, codes = np.divmod(keys, len(dictionary))
    terms = {t for kind in IDENTITY_TERMS for t in kind}
    spelled = dictionary.to_pylist()
    out_rows, out = [rows], [hash_words(dictionary)[codes]]
    for length in BEGINNINGS:
        begun = pa.array([w[:length] if len(w) > length and w not in terms else None for w in spelled]).dictionary_encode()
        index = begun.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        held = index >= 0
        if held.any():
            keys = np.unique(rows[held] * len(begun.dictionary) + index[held])
            r, i = np.divmod(keys, len(begun.dictionary))
            out_rows.append(r)
            out.append(hash_words(begun.dictionary, length)[i])
    rows, out = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((out, rows))
    return rows[order], out[order]


def swapped(rows: np.ndarray, hashed: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with every identity term replaced by the ``turn``-th after it of its kind."""
    out = hashed.copy()
    for kind in term_hashes():
        order = np.argsort(kind)
        at = np.minimum(np.searchsorted(kind[order], hashed), len(kind) - 1)
        hit = kind[order][at] == hashed
        out[hit] = kind[(order[at[hit]] + turn) % len(kind)]
    return rows, out


def fit_words(
    rows: np.ndarray, hashed: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, fairness: float = FAIRNESS, ridge: float = RIDGE
) -> WordModel:
    """Fit by gradient steps with a diagonal preconditioner; ``rows`` number the labelled texts, sorted."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (float((sample_weight * y).sum()) + 1) / (float(sample_weight.sum()) + 2)
        return WordModel(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))
    found, index, counts = np.unique(hashed, return_inverse=True, return_counts=True)
    toxic = np.bincount(index, weights=y[rows], minlength=len(found))
    share = y.mean()
    # Chi-square score of word and label.
    gain = (toxic - counts * share) ** 2 / (counts * share * (1 - share))
    terms = np.concatenate(term_hashes())
    gain[counts < MIN_TEXTS] = -1
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    vocabulary = np.unique(np.concatenate([found[best[gain[best] > 0]], terms]))

    def matrix(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        pairs = np.unique(r[known] * len(vocabulary) + at[known])  # a swapped text may name a group twice
        return np.divmod(pairs, len(vocabulary))

    r, c = matrix(rows, hashed)
    named = np.isin(hashed, terms)
    mentions = np.isin(rows, rows[named])
    pairs = []
    for turn in (1, 2, 3):
        other = matrix(*swapped(rows[mentions], hashed[mentions], turn))
        pairs.append((np.concatenate([r[np.isin(r, rows[named])], other[0]]), np.concatenate([c[np.isin(r, rows[named])], other[1]]),
                      np.concatenate([np.ones(np.isin(r, rows[named]).sum()), -np.ones(len(other[0]))])))
    size = len(vocabulary)
    w, bias = np.zeros(size), float(np.log(share / (1 - share)))
    total = sample_weight.sum()
    velocity, spread = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, 401):  # Adam: sparse products only
        z = bias + np.bincount(r, weights=w[c], minlength=n)
        error = sample_weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(c, weights=error[r], minlength=size) + ridge * w
        for pr, pc_, sign in pairs:
            change = np.bincount(pr, weights=sign * w[pc_], minlength=n)
            g += fairness / len(pairs) * np.bincount(pc_, weights=sign * change[pr], minlength=size)
        g = np.append(g, error.sum()) / total
        velocity, spread = 0.9 * velocity + 0.1 * g, 0.999 * spread + 0.001 * g * g
        move = 0.05 * (velocity / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return WordModel(vocabulary, w, float(bias))


def rising_shares(z: np.ndarray, y: np.ndarray, sample_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising step function from logits to shares of label 1, as points to interpolate.

    Neighbours that violate the order are pooled; a pool counts one more text, which has the overall share.
    """
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []  # weight, weight of label 1, first and last logit
    for logit, label, w in zip(z[order].tolist(), y[order].tolist(), sample_weight[order].tolist()):
        pools.append([w, w * label, logit, logit])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
            pools[-1][3] = last[3]
    mean = float((sample_weight * y).sum() / sample_weight.sum())
    shares = np.maximum.accumulate([(toxic + mean) / (w + 1) for w, toxic, _, _ in pools])
    points = np.array([[lo, hi] for _, _, lo, hi in pools]).ravel()
    return points, np.repeat(shares, 2)


def calibrated(model: WordModel, rows: np.ndarray, hashed: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, fairness: float) -> WordModel:
    """``model`` with probabilities read off texts that the fit of their part did not see.

    A penalised fit understates what it knows: on unseen texts far more of those it scores 0.5 are of label 1.
    Parts with one label only, or too few texts, leave the model as it is.
    """
    part = np.arange(len(y)) % PARTS
    if len(y) < 50 * PARTS or any(len(set(y[part != k].tolist())) < 2 for k in range(PARTS)):
        return model
    z = np.empty(len(y))
    for k in range(PARTS):
        number = np.cumsum(part != k) - 1
        seen = part[rows] != k
        fitted = fit_words(number[rows[seen]], hashed[seen], y[part != k], sample_weight[part != k], fairness)
        z[part == k] = fitted.logits(rows, hashed, len(y))[part == k]
    model.known_logits, model.known_shares = rising_shares(z, y, sample_weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fairness: float = FAIRNESS) -> WordModel:
    """Fit on at most about ``rows`` labelled documents of each class; ``labels`` has ``doc_id, label``.

    Tasks reduce the chosen texts to feature hashes; the driver gets those only. Null labels
    and texts are left out; with one class only the score is constant.
    """
    chosen = []
    for label in (0, 1):
        own = labels.where(F.col("label") == label)
        chosen.append(own.where(share_of(own, "doc_id", rows)).select("doc_id", "label").limit(2 * rows))
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by rows
    read = docs.where("text IS NOT NULL").select("doc_id", "text").join(sample, "doc_id")
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, hashed = word_features(part.column("text"))
                borders = np.searchsorted(at, np.arange(part.num_rows + 1))
                packed = [hashed[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "held"])

    kind = dict(sample.dtypes)["label"]
    held = read.select("doc_id", "label", "text").mapInArrow(apply, f"doc_id long, label {kind}, held binary").collect()
    held = sorted(held, key=lambda r: (r.doc_id, bytes(r.held)))
    sizes = [len(r.held) // 8 for r in held]
    hashed = np.frombuffer(b"".join(bytes(r.held) for r in held), np.uint64)
    y = np.array([r.label for r in held], float)
    n = [labels.where(F.col("label") == k).count() for k in (0, 1)]
    weight = np.where(y == 1, n[1] / max(1.0, y.sum()), n[0] / max(1.0, (1 - y).sum()))
    weight = weight / max(1e-9, weight.mean()) if len(y) else weight
    rows_of = np.repeat(np.arange(len(held)), sizes)
    return calibrated(fit_words(rows_of, hashed, y, weight, fairness), rows_of, hashed, y, weight, fairness)


def score_toxicity(docs: DataFrame, model: WordModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` plus ``score``, the probability of label 1; null and empty texts get that of a text without words."""
    if score in docs.columns:
        raise ValueError(f"column {score} exists already")
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                p = pa.array(model.scores(*word_features(part.column(text)), part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns, p], [*part.schema.names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(apply, f"{fields}, `{score}` double")
