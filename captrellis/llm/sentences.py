"""Substring deduplication over sliding sentence spans.

Every run of consecutive sentences with enough words is hashed, from each sentence on; runs are grouped over the
whole corpus; all but the first place of a repeated run are marked, and marked sentences are cut out.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or with the text. In running text without such
marks a sentence is cut where its words say so: after a word whose hash is divisible by :data:`CUT`, once it has
as many words. The cuts follow the content, so equal passages are cut alike wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches, hash_words, mix, slices, words

#: Sentences and words that a run has at least.
RUN_SENTENCES = 2
RUN_WORDS = 20
CUT = 8
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence_starts(codes: np.ndarray, starts: np.ndarray, dictionary: pa.Array, hashed: np.ndarray) -> np.ndarray:
    """Word positions at which sentences start, for all texts in order."""
    n = len(codes)
    closing = pc.match_substring_regex(dictionary, r"[.!?]$").to_numpy(zero_copy_only=False).astype(bool)[codes]
    cutting = (hashed % np.uint64(CUT) == 0)[codes]
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    begins[1:] |= closing
    # Words since the last sentence start; only the first cut after CUT words is taken, then counting goes on.
    at = np.arange(n)
    while True:
        since = at - np.maximum.accumulate(np.where(begins[:n], at, 0)) + 1
        due = cutting & (since >= CUT) & ~begins[1:]
        if not due.any():
            return np.flatnonzero(begins[:n])
        # The first due word of each sentence: later ones may not be due once it has cut.
        sentence = np.cumsum(begins[:n])
        places = np.flatnonzero(due)
        _, first = np.unique(sentence[places], return_index=True)
        begins[places[first] + 1] = True


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, word after the last, and two hashes of every run."""
    codes, starts, dictionary = words(texts)
    none = np.empty(0, np.int64)
    if not len(codes):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = hash_words(dictionary)
    begins = sentence_starts(codes, starts, dictionary, hashed)
    rows = np.searchsorted(starts, begins, side="right") - 1
    ends = starts[rows + 1]
    borders = np.append(begins, len(codes))
    # The first sentence border that is far enough in words and in sentences.
    last = np.maximum(np.searchsorted(borders, begins + RUN_WORDS), np.arange(len(begins)) + RUN_SENTENCES)
    fits = last < len(borders)
    stop = borders[np.minimum(last, len(borders) - 1)]
    fits &= stop <= ends
    row, start, stop = rows[fits], begins[fits], stop[fits]
    both = []
    for base in BASES:
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(codes), base, np.uint64))])
        inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(codes), pow(base, -1, 1 << 64), np.uint64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashed ^ np.uint64(base))[codes] * power[:-1])])
        both.append(mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    return row, start - starts[row], stop - starts[row], both[0], both[1]


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, start, stop``: word spans of all non-first places of repeated runs; the first is the smallest ``(id, start)``.

    The runs are grouped by their hashes after partial aggregation; the places of a run are joined to its one
    first place, which adaptive execution splits where a run is very frequent.
    """
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                row, start, stop, a, b = runs(part.column(text))
                ids = part.column(key).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    ["id", "start", "stop", "h1", "h2"],
                )

    found = docs.select(key, text).mapInArrow(apply, "id long, start int, stop int, h1 long, h2 long")
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("places"))
    firsts = firsts.where("places > 1").select("h1", "h2", "first")
    later = found.join(firsts, ["h1", "h2"]).where("NOT (id <=> first.id AND start = first.start)")
    return later.select("id", "start", "stop")


def dedup_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_words``, ``n_removed`` and ``removed`` (merged word spans, ``start:end,...``).

    Of a passage that stands in several places, the place with the smallest key and position stays. Words stand
    between ASCII white space; what is left of a text keeps its own white space. Null texts stay null; texts with
    too few sentences have no runs. Rows with one key are places of one document: a run that stands in both is
    kept in both if it is first there. All rows and other columns stay.
    """
    clash = {"n_words", "n_removed", "removed", "_spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    spans = repeated_runs(docs, key, text)
    spans = spans.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))  # at most a text's sentences
    joined = docs.join(spans.withColumnRenamed("id", "_id"), docs[key].eqNullSafe(F.col("_id")), "left").drop("_id")
    kept = docs.columns
    names = [*kept, "n_words", "n_removed", "removed"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = [_cut(t, s) for t, s in zip(part.column(text).to_pylist(), part.column("_spans").to_pylist())]
                columns = {c: part.column(c) for c in kept}
                columns[text] = pa.array([x[0] for x in out], pa.string())
                for i, c in enumerate(("n_words", "n_removed"), 1):
                    columns[c] = pa.array([x[i] for x in out], pa.int64())
                columns["removed"] = pa.array([x[3] for x in out], pa.string())
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.select(*docs.columns, "_spans").mapInArrow(apply, f"{fields}, n_words long, n_removed long, removed string")


def _cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int, str]:
    """The text without the spans, its words, the words removed, and the merged spans."""
    if not spans:
        return text, len((text or "").encode().split()), 0, ""
    found = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    kept, at = [], 0
    for start, stop in merged:
        kept.append(text[at : found[start][0]])
        at = found[stop][0] if stop < len(found) else len(text)
    kept.append(text[at:])
    return "".join(kept), len(found), sum(b - a for a, b in merged), ",".join(f"{a}:{b}" for a, b in merged)
