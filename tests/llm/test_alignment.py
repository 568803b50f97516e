"""Alignment against the definition, worked out token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from captrellis.llm.alignment import Aligner, alignment_counts, linked_pairs
from captrellis.llm.tokens import ByteTokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "The cat sat.", "naïve café ﬁń é", "▁x", "<s> </s> <0x41> <|endoftext|>", "a  b\n\n\tc ",
    "\x00 odd �​", "日本語のテキスト 한국어 русский", "🙂👩‍👩‍👧 emoji", "x" * 3000, " " * 5000, "12345 67,890.12 a1b2",
    "The cat sat.", "don't WON'T it's", "zzzz" * 200 + "qqqq",
]


def by_definition(texts):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    keep = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    letter = {chr(c): c for c in keep} | {chr(256 + n): c for n, c in enumerate(x for x in range(256) if x not in keep)}
    rows, docs = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(([], [], [], []))
            continue
        groups, i, j, at = [([], [])], 0, 0, [0, 0]
        while i < len(ids_a) or j < len(ids_b):
            if at[0] <= at[1] and i < len(ids_a):
                groups[-1][0].append(ids_a[i])
                at[0] += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(ids_b[j])
                at[1] += len(bytes_b[j])
                j += 1
            if at[0] == at[1] and (i < len(ids_a) or j < len(ids_b)):
                groups.append(([], []))
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        docs.update(set(links))
        rows.append((ids_a, ids_b, groups, links))
    top = Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for ids_a, ids_b, groups, links in rows:
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if ids_a else ""
        best = sum(docs[p] == top[p[0]] for p in links)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(docs[p] for p in links), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_equals_the_definition(spark, block):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a long").repartition(3)
    out = alignment_counts(docs, BYTES, PIECES, block=block)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert [got[i] for i in range(len(TEXTS))] == by_definition(TEXTS)


def test_documents_equal_the_definition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = alignment_counts(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, PIECES)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert [got[r.doc_id] for r in rows] == by_definition([r.text for r in rows])


def test_null_and_repeated_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one"), (7, None)], "doc_id long, text string")
    out = alignment_counts(docs, BYTES, PIECES)
    assert sorted((r.doc_id or 0, r.n_a) for r in out.collect()) == [(0, 2), (0, 2), (7, 0), (7, 1)]
    assert alignment_counts(docs.where("doc_id > 9"), BYTES, PIECES).count() == 0


def test_large_groups_expand_in_steps(monkeypatch):
    a, b = np.array([1, 2, 1, 3] * 10), np.array([5, 6, 5] * 9)
    cuts = np.array([8, 40]), np.array([2, 27])
    whole = linked_pairs(a, b, *cuts)
    monkeypatch.setattr("captrellis.llm.alignment.LINK_STEP", 7)
    small = linked_pairs(a, b, *cuts)
    assert [x.tolist() for x in whole] == [x.tolist() for x in small]
    expected = Counter(int(x) << 32 | int(y) for g in ((a[:8], b[:2]), (a[8:], b[2:])) for x in g[0] for y in g[1])
    assert dict(zip(*[x.tolist() for x in whole])) == expected


def test_both_libraries_agree_on_every_code_point():
    plain, special = ByteTokens(BYTES, special=False), ByteTokens(BYTES, special=True)
    assert plain.fast and special.fast
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} ,{chr(c)}," for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["a<|endoftext|>b", " <|endoftext|>\n\n x", "it's  we'LL \n don't", " " * 999 + "x", "\n" * 5000 + " y"]
    for tokens in (plain, special):
        slow = [e.ids for e in tokens.slow.encode_batch(texts, add_special_tokens=False)]
        assert [tokens.encode(t) for t in texts] == slow


def test_tokens_spell_the_text():
    aligner = Aligner(BYTES, PIECES)
    a, b, ends, _ = next(aligner.tokens(["plain words"]))
    assert ends.tolist() == [6, 12]
    assert b"".join(aligner.bytes_a[i] for i in a) == b"".join(aligner.bytes_b[i] for i in b) == b" plain words"
    assert aligner.bytes_a[50256] == b"<|endoftext|>"

