import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from captrellis.llm import bpe
from captrellis.llm.bpe import Encoder, bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return Encoder(f.read())


def odd_texts():
    rng = random.Random(5)
    letters = "aabbccddeeéüßñ  \n\t.,!?'0123日本語́ΣİĲ🙂\x1c\x85 ﬁ%"
    out = ["", " ", "I'll we've it's 'LL", "<|endoftext|>a<|startoftext|> b", "aaaaaaaaaaaaaaaa", "ΑΣ Σ", "áb ́c", "1234567"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    out += ["".join(rng.choice("aeiourstnlhdm") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    return out + ["x" * 3000, "ab" * 2000, "the quick brown fox " * 500]


def test_equals_library(encoder):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == want, repr(text)
        assert encoder.decode(encoder.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_operator_keeps_rows_and_columns(spark):
    rows = [(1, "A cat", "x"), (1, "A cat", "x"), (2, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    out = bpe_decode(bpe_encode(df, PATH), PATH)
    got = sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in out.collect())
    assert got == [(0, "", 0), (1, "a</w> cat</w>", 8), (1, "a</w> cat</w>", 8), (2, "", 0)]
    assert out.columns == ["doc_id", "text", "note", "ids", "decoded"]
    assert bpe_encode(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(out, PATH)


def test_one_pass_equals_two(spark):
    rows = [(1, "A cat", "x"), (1, "A cat", "x"), (2, None, None), (None, "", "y"), (3, "Été I'll " * 40_000, "z"), *((9, t, "") for t in odd_texts()[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(2)
    once = bpe_encode(df, PATH, decoded="decoded")
    twice = bpe_decode(bpe_encode(df, PATH), PATH)
    assert once.schema == twice.schema
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    with pytest.raises(ValueError):
        bpe_encode(df, PATH, decoded="note")


def test_known_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 100)
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    library = Tokenizer.from_file(PATH)
    for text in ["".join(random.Random(7).choices("aeiourstnlhdm", k=2000)), *odd_texts()[:300]]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.fits) <= 100
