"""Byte-level token ids of whole texts, as the tokenizers library gives them.

The same vocabulary is read by two libraries. One of them is several times faster and gives equal ids (a test compares
them on every code point), but fails on very long runs of white space; texts with such runs, and all texts if there is
no file of ranks beside the vocabulary, go to the other one.
"""

from __future__ import annotations

import base64
import os
import re
from pathlib import Path

#: White space from which on a text is left to the slower library.
LONG_BLANK = re.compile(r"\s{1000}")


class ByteTokens:
    """Ids of texts for one byte-level vocabulary file (``.json``).

    ``special`` says whether strings of special tokens inside texts become their ids or stay plain text.
    """

    def __init__(self, path: str, special: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = not special
        self.fast = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            held = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.read_bytes().splitlines()))
            names = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
            own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens=names)
            self.fast = (lambda t: own.encode(t, allowed_special="all")) if special else own.encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id, by undoing the byte-level alphabet; special tokens stand for their names."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {i: t.content for i, t in self.slow.get_added_tokens_decoder().items()}
        size = self.slow.get_vocab_size()
        pieces = ((i, self.slow.id_to_token(i)) for i in range(size))
        return [p.encode() if i in special else bytes(letters[c] for c in p) for i, p in pieces]
