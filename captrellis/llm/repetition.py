"""Quality rules on repetition inside a text, by suffix arrays.

The suffixes of a text's words are sorted by prefix doubling; the common prefix of neighbours in that order is
read back from the ranks of the doubling steps. The largest LCP interval around suffix ``i`` with ``LCP >= n``
gives the longest repeat that starts at word ``i``; the union of these spans is what all maximal repeated
substrings of at least ``n`` words cover. (All of it holds for ``n = 3`` too, which gives the repeated windows.) A text is turned down if that share of its words, or the longest
repeat, is over a limit.

Texts never meet each other: the first rank of a suffix is its (text, word) pair, and a common prefix ends with
the text. Only suffixes whose first words occur elsewhere in the same text are sorted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from captrellis.llm.common import bounded_batches, slices, words

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Repeats of fewer words are ignored.
MIN_REPEAT = 8
#: Share of words that repeats may cover, and words that the longest repeat may have.
MAX_COVERED = 0.3
MAX_LONGEST = 100

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)


def suffix_ranks(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two suffixes share a rank.

    Equal ranks mean equal words inside one text: a suffix that is too short for a step has a rank of its own. A
    rank is the number of suffixes before its class, so the last array is the suffix array's inverse.
    """
    n = len(codes)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = starts[1:][rows]
    key = rows * (int(codes.max()) + 1 if n else 1) + codes
    alive, rank, ranks, step = np.arange(n), np.zeros(n, np.int64), [], 1
    while len(alive):
        order = np.argsort(key, kind="stable")
        places, sorted_key, base = alive[order], key[order], rank[alive[order]]
        at = np.arange(len(order))
        first = np.concatenate([[True], base[1:] != base[:-1]])
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = rank.copy()
        rank[places] = base + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        ranks.append(rank)
        alone = fresh & np.concatenate([fresh[1:], [True]])
        alive = np.sort(places[~alone])  # the others differ from every suffix already
        ahead = alive + step
        second = np.where(ahead < ends[alive], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[alive] * (n + 1) + second
        step *= 2
    return ranks


def repeat_lengths(ranks: list[np.ndarray], least: int) -> np.ndarray:
    """For every word, the length of the longest repeat of at least ``least`` words that starts there, else 0."""
    n = len(ranks[0]) if ranks else 0
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    left, right = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = left + lcp, right + lcp
        same = (a < n) & (b < n)
        same &= ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)]
        lcp[same] += 2**level
    lcp[lcp < least] = 0
    found[left] = lcp
    found[right] = np.maximum(found[right], lcp)
    return found


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in the union of the spans ``[i, i + lengths[i])``."""
    reach = np.maximum.accumulate(np.where(lengths > 0, np.arange(len(lengths)) + lengths, 0))
    return reach > np.arange(len(lengths))


def per_row(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive borders."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of :data:`COLUMNS` for a slice of texts."""
    texts = pc.fill_null(texts, "")
    codes, starts, _ = words(texts)
    lines = [[x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")] for t in texts.to_pylist()]
    encoded = [t.encode() for t in texts.to_pylist()]
    borders = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    in_word = np.ones(256, bool)
    in_word[[32, *range(9, 14), *range(128, 192)]] = False  # blanks, and bytes that continue a character
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    ranks = suffix_ranks(codes, starts)
    repeats = repeat_lengths(ranks, 3)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), np.diff(starts)), repeats)
    return [
        np.diff(starts),
        per_row(in_word[data], borders),
        per_row(symbol[data], borders),
        np.array([len(x) - len(set(x)) for x in lines], np.int64),
        per_row(covered(repeats), starts),
        per_row(covered(np.where(repeats >= MIN_REPEAT, repeats, 0)), starts),
        longest,
    ]


def repetition_rules(
    docs: DataFrame, text: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """``docs`` plus counts, ``covered_words``, ``longest_repeat``, ``base_failed`` and ``kept``.

    Words stand between ASCII white space. ``base_failed``: fewer than 50 words, or more than half of the words
    in repeated three-word windows. ``kept``: not ``base_failed``, repeats of :data:`MIN_REPEAT` or more words
    cover at most ``max_covered`` of the words, and none is longer than ``max_longest`` words. Null and empty
    texts have no words and fail. Rows are judged one by one; all rows and columns stay.
    """
    clash = {c.split()[0] for c in COLUMNS.split(", ")} | {"base_failed", "kept"}
    if clash & set(docs.columns):
        raise ValueError(f"columns {sorted(clash & set(docs.columns))} exist already")
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for part in slices(batch, text):
                found = [pa.array(x, pa.int64()) for x in measure(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(apply, f"{fields}, {COLUMNS}")
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    fine = f"covered_words <= {max_covered!r} * n_words AND longest_repeat <= {max_longest}"
    return out.selectExpr("*", f"{failed} AS base_failed", f"NOT ({failed}) AND {fine} AS kept")
