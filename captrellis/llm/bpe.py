"""BPE encoding by a unique last token per prefix, and decoding.

A vocabulary whose every token is made by exactly one merge has a useful property: a token sequence is the BPE
encoding of its text exactly if each token and each neighbouring pair encodes to itself. So every prefix of a
word has one possible last token. The encoder walks a word through a suffix automaton of the vocabulary, which
names the tokens ending at each position, keeps the one that is compatible with the last token of the prefix
before it, and reads the ids off the back-pointers. Time is linear in the word for a vocabulary of bounded
token length; nothing is merged.

Null and empty texts have no ids and decode to the empty string.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from captrellis.llm.common import BATCH_BYTES, bounded_batches, worker_cache

#: Unicode white space, which ends a chunk, and the pattern of pieces within a chunk.
WHITE_SPACE = "".join(
    map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Last symbols of words are moved to this plane, so that "a" and "a</w>" are two symbols of one character each.
END_PLANE = 0xE000
#: Chunks remembered by a Python worker; half of them are forgotten at a time.
CACHED_CHUNKS = 400_000
#: Pairs of tokens remembered by a Python worker; their number grows with the text, so beyond this all are forgotten.
KNOWN_PAIRS = 1 << 18
#: Stands for the last token of an empty prefix.
FIRST = (1 << 20) - 1


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class SuffixAutomaton:
    """Suffix automaton of a set of strings; ``token[state]`` names the string that is the state's longest."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.token = [-1]
        self.shorter = [0]

    def _state(self, size: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.token.append(-1)
        return len(self.size) - 1

    def _split(self, state: int, char: str) -> int:
        """The state of ``state``'s longest string plus ``char``, separated from longer ones if need be."""
        target = self.next[state][char]
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._state(self.size[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(char) == target:
            self.next[state][char] = copy
            state = self.link[state]
        return copy

    def add(self, string: str, token: int) -> None:
        state = 0
        for char in string:
            if char in self.next[state]:
                state = self._split(state, char)
                continue
            new = self._state(self.size[state] + 1, {}, 0)
            while state >= 0 and char not in self.next[state]:
                self.next[state][char] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, char)
            state = new
        self.token[state] = token

    def close(self) -> SuffixAutomaton:
        """Point every state to the nearest one on its suffix path that is a whole token."""
        self.shorter = [0] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up = self.link[state]
            self.shorter[state] = up if self.token[up] >= 0 else self.shorter[up]
        return self


class Encoder:
    """Exact BPE for vocabularies whose words end in a marked symbol."""

    def __init__(self, definition: str, encodes: bool = True) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        self.texts = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in model["vocab"].items():
            self.texts[i] = text
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.texts[i] = text
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        if encodes:
            self._read_merges(model)
        self.letters = byte_letters()
        self.vocab = model["vocab"]
        self.spelled: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks = re.compile(f"[^{WHITE_SPACE}]+")
        self.pieces = regex.compile(PIECES)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _read_merges(self, model: dict) -> None:
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merges[a, b] = (rank, whole)
            self.parts[whole] = (a, b)
            self.born[whole] = rank

    @cached_property
    def automaton(self) -> SuffixAutomaton:
        """Automaton of all tokens; decoding does without it."""
        automaton = SuffixAutomaton()
        for text, i in self.vocab.items():
            if text in self.special:
                continue
            if text.endswith(WORD_END) and text != WORD_END:
                body = text[: -len(WORD_END)]
                text = body[:-1] + chr(END_PLANE + ord(body[-1]))
            automaton.add(text, i)
        return automaton.close()

    def _pair_fits(self, left: int, right: int) -> bool:
        """Whether encoding ``left + right`` leaves the border between them alone.

        The symbols on both sides of the border grow merge by merge, in the order of ranks. The border is lost
        at the first moment when its two symbols may merge before either of them is used up on its own side; of
        equal merges the left one comes first.
        """
        lefts, rights = [left], [right]
        while lefts[-1] in self.parts:
            lefts.append(self.parts[lefts[-1]][1])
        while rights[-1] in self.parts:
            rights.append(self.parts[rights[-1]][0])
        i, j, never = len(lefts) - 1, len(rights) - 1, len(self.merges)
        while True:
            crossing = self.merges.get((lefts[i], rights[j]), (never,))[0]
            grows_left = self.born[lefts[i - 1]] if i else never
            grows_right = self.born[rights[j - 1]] if j else never
            if crossing < grows_left and crossing <= grows_right and crossing < never:
                return False
            if not i and not j:
                return True
            if grows_left <= grows_right:
                i -= 1
            else:
                j -= 1

    def _reachable(self, token: int) -> bool:
        """Whether a token's own text encodes to it: its two parts do, and only its last merge joins them."""
        found = self.spelled.get(token)
        if found is None:
            parts = self.parts.get(token)
            found = parts is None or (self._reachable(parts[0]) and self._reachable(parts[1]) and self._joins(*parts))
            self.spelled[token] = found
        return found

    def _joins(self, left: int, right: int) -> bool:
        """Whether the border of two parts holds until the parts themselves merge."""
        whole = self.merges.pop((left, right))
        try:
            return self._pair_fits(left, right)
        finally:
            self.merges[left, right] = whole

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow the last token of a prefix (:data:`FIRST`: the empty one)."""
        return self._reachable(token) and (before == FIRST or self._pair_fits(before, token))

    @cached_property
    def _endings(self) -> list:
        return [()] + [None] * len(self.automaton.size)

    def _tokens_at(self, state: int) -> tuple:
        """Tokens, with their lengths, that end where the automaton is in ``state``, longest first."""
        auto, found, at = self.automaton, [], state
        while at:
            if auto.token[at] >= 0:
                found.append((auto.token[at], auto.size[at]))
            at = auto.shorter[at]
        self._endings[state] = tuple(found)
        return self._endings[state]

    def word(self, piece: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        text = piece[:-1] + chr(END_PLANE + ord(piece[-1]))
        auto, fits, endings = self.automaton, self.fits, self._endings
        moves, link, size, token, shorter = auto.next, auto.link, auto.size, auto.token, auto.shorter
        last, lengths = [FIRST], [0]
        state = length = 0
        for char in text:
            then = moves[state].get(char, 0)
            while state and not then:
                state = link[state]
                length = size[state]
                then = moves[state].get(char, 0)
            state = then
            length = length + 1 if state else 0
            at = state if size[state] == length else shorter[state]
            end = len(last)
            for t, n in endings[at] or self._tokens_at(at):
                before = last[end - n]
                key = before << 20 | t
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= KNOWN_PAIRS:
                        fits.clear()
                    ok = fits[key] = self._fits(before, t)
                if ok:
                    last.append(t)
                    lengths.append(n)
                    break
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= lengths[end]
        ids.reverse()
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without white space."""
        found = self.old.get(chunk)
        if found is None:
            plain = chunk.isascii()
            text = chunk.lower() if plain else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            letters, ids = self.letters, []
            for piece in [text] if plain and text.isalpha() else self.pieces.findall(text):
                if plain:  # printable ASCII stands for itself
                    ids += self.word(piece if piece.isprintable() else "".join([letters[b] for b in piece.encode()]))
                else:
                    ids += self.word("".join([letters[b] for b in piece.encode()]))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.young) >= CACHED_CHUNKS // 2:
            self.old, self.young = self.young, {}
        if len(chunk) <= 64:
            self.young[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        out = []
        special = self.special_pattern is not None and any(s in text for s in self.special)
        for part in self.special_pattern.split(text) if special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            for chunk in self.chunks.findall(part):
                got = self.young.get(chunk)
                out.append(self.chunk(chunk) if got is None else got)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Token texts of packed ids, parted by blanks."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoder(definition, encodes: bool) -> Encoder:
    held = worker_cache("bpe")
    key = hash(definition.value), encodes
    if key not in held:
        held[key] = Encoder(definition.value, encodes)
    return held[key]


def _with_columns(df: DataFrame, added: list[tuple[str, DataType, str]], source: str, tokenizer: str) -> DataFrame:
    """``df`` plus one column, ``(name, type, step)``, for each step; a step goes on from what the one before it gave.

    All steps run in one worker of a task, which holds the vocabulary once.
    """
    for name, _, _ in added:
        if name in df.columns:
            raise ValueError(f"column {name} exists already")
    spark = df.sparkSession
    bounded_batches(spark)
    definition = spark.sparkContext.broadcast(_definition(tokenizer))
    names, steps = [name for name, _, _ in added], [step for _, _, step in added]
    schema = StructType([*df.schema.fields, *(StructField(name, kind) for name, kind, _ in added)])
    arrow = [pa.binary() if kind == BinaryType() else pa.string() for _, kind, _ in added]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition, "encode" in steps)
        made = [getattr(encoder, step) for step in steps]
        for batch in batches:
            values = batch.column(source)
            at = done = held = 0
            out: list[list] = [[] for _ in made]
            for value in values:  # results leave in pieces: ids and token texts are larger than the text
                got = value.as_py()
                for step, column in zip(made, out):
                    got = step(got)
                    column.append(got)
                    held += len(got)
                at += 1
                if held > BATCH_BYTES or at == batch.num_rows:
                    part = batch.slice(done, at - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, out, arrow)], [*batch.schema.names, *names])
                    done, out, held = at, [[] for _ in made], 0

    return df.mapInArrow(apply, schema)


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` plus packed ids of column ``text``; ``tokenizer`` is the path of a vocabulary file.

    Ids are little-endian unsigned 32-bit integers in one binary value, the form tensors are read from. Equal to
    ``Tokenizer.encode(text, add_special_tokens=False)``. Every row is kept, with all its columns; a null text
    has empty ids. ``decoded`` names a further column, that of :func:`bpe_decode` over the ids: made here it needs
    no second worker in each task.
    """
    added = [(ids, BinaryType(), "encode"), *([(decoded, StringType(), "decode")] if decoded else [])]
    return _with_columns(df, added, text, tokenizer)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` plus the text of packed ids, equal to ``Tokenizer.decode(ids, skip_special_tokens=False)``."""
    return _with_columns(df, [(decoded, StringType(), "decode")], ids, tokenizer)
