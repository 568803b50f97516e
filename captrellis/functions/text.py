"""Caption normalisation, tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that the caption metric ignores.
PUNCTUATION = [
    "''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-",
    ".", "?", "!", ",", ":", "-", "--", "...", ";",
]

# Names the Penn Treebank convention gives to brackets, lower-cased.
_BRACKET_NAMES = {
    "(": "-lrb-", ")": "-rrb-", "[": "-lsb-", "]": "-rsb-", "{": "-lcb-", "}": "-rcb-",
}

_WORD_BREAK = r"[^\p{L}\p{N}]+"

#: Characters of a sentence that are turned into an array of tokens at a time.
PIECE_CHARS = 65_536

# Per tokeniser: what a piece ends with, what it takes along behind that, and what a following word looks like. In
# ``ptb_lite`` no token spans white space, and only signs of the punctuation list vanish, so a run without
# white space that has another sign holds a token.
_CUTS = {
    "words": (r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]++[^\p{L}\p{N}]*+"),
    "ptb_lite": (r"\S", r"\s", r"[\s'`.?!,:;-]*+\S++"),
}

# One alternative per Penn Treebank token shape, longest shapes first.
_PTB_SHAPES = "|".join(
    [
        r"https?://[^\s]+",
        r"[\w.+]+@[\w-]+(?:\.[\w-]+)+",
        r"\d+(?:[.,:]\d+)+",
        r"can(?=not\b)|(?<=can)not\b",
        r"\p{L}+(?=n't\b)|n't\b",
        r"'(?:s|m|d|re|ve|ll)\b",
        r"(?:\p{L}\.){2,}",
        r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*",
        r"\.{3}|--|``|''",
        r"\S",
    ]
)


def normalize(text: Column | str) -> Column:
    """A sentence on a single line."""
    return F.replace(_col(text), F.lit("\n"), F.lit(" "))


def tokens(text: Column | str, mode: str = "words") -> Column:
    """Lower-cased caption tokens without punctuation.

    ``words``     runs of letters and digits (brackets and all signs vanish);
    ``ptb_lite``  Penn-Treebank-like: contractions split, hyphenated words and
                  decimals kept whole, brackets renamed, the fixed punctuation
                  list removed.
    """
    line = F.lower(normalize(text))
    if mode == "words":
        return F.filter(F.split(line, _WORD_BREAK), lambda t: t != "")
    if mode == "ptb_lite":
        named = line
        for sign, name in _BRACKET_NAMES.items():
            named = F.replace(named, F.lit(sign), F.lit(f" {name} "))
        shapes = "|".join(_BRACKET_NAMES.values()) + "|" + _PTB_SHAPES
        found = F.regexp_extract_all(named, F.lit(f"({shapes})"), F.lit(1))
        return F.filter(found, lambda t: ~t.isin(*PUNCTUATION))
    raise ValueError(f"unknown tokeniser {mode!r}; use 'words' or 'ptb_lite'")


def pieces(text: Column | str, n: int, mode: str = "words", chars: int = PIECE_CHARS) -> Column:
    """``array<struct<no, own, ahead>>``: a sentence cut into pieces of about ``chars`` characters.

    Cuts lie between tokens, so the pieces' tokens in order are those of the whole sentence. ``ahead`` is the text
    of at least ``n - 1`` tokens behind the piece, as far as there are any: what the grams that start in it reach
    into. A sentence of at most ``chars`` characters, also an empty one, is one piece. A NULL has none.
    """
    # Lower case depends on the letters around; make it before cutting.
    line = F.lower(normalize(text))
    inside, behind, word = _CUTS[_known(mode)]
    cut = f"(?s)(.{{0,{chars}}}{inside}*+{behind}*+)(?=((?:{word}){{0,{n - 1}}}))"
    long = F.arrays_zip(
        F.regexp_extract_all(line, F.lit(cut), F.lit(1)).alias("own"), F.regexp_extract_all(line, F.lit(cut), F.lit(2)).alias("ahead")
    )
    # The expression also matches nothing, once, at the end of the text.
    long = F.filter(long, lambda p: p["own"] != "")
    whole = F.array(F.struct(line.alias("own"), F.lit("").alias("ahead")))
    return F.transform(
        F.when(F.char_length(line) <= chars, whole).otherwise(long),
        lambda p, i: F.struct(i.alias("no"), p["own"].alias("own"), p["ahead"].alias("ahead")),
    )


def token_count(text: Column | str, mode: str = "words", chars: int = PIECE_CHARS) -> Column:
    """Number of tokens, counted without an array of them, or piece by piece."""
    if mode == "words":
        return F.regexp_count(F.lower(normalize(text)), F.lit(r"[\p{L}\p{N}]++")).cast("bigint")
    counts = F.transform(pieces(text, 1, mode, chars), lambda p: F.size(tokens(p["own"], mode)).cast("bigint"))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)


def grams(toks: str, n: int, mine: int | str = 1, starts: str | None = None) -> Column:
    """``array<struct<n, gram, mine>>``: all 1- to n-grams in order, words joined by one space.

    Repeats stay; ``mine`` tags the sentence the grams come from. ``toks`` names a
    column, so that the tokens, used many times here, are computed once. ``starts`` names the
    number of leading words at which grams may start; others only end grams.
    """

    def of(k: int) -> str:
        words = ", ' ', ".join(f"get({toks}, i + {j})" for j in range(k))
        last = f"size({toks}) - {k}" if starts is None else f"least({starts} - 1, size({toks}) - {k})"
        return f"""
            CASE WHEN {last} >= 0 THEN transform(
                sequence(0, {last}),
                i -> named_struct('n', {k}, 'gram', concat({words}), 'mine', {mine})
            ) ELSE cast(array() AS array<struct<n:int,gram:string,mine:int>>) END"""

    return F.expr(f"concat({', '.join(of(k) for k in range(1, n + 1))})")


def _known(mode: str) -> str:
    if mode not in _CUTS:
        raise ValueError(f"unknown tokeniser {mode!r}; use 'words' or 'ptb_lite'")
    return mode


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
