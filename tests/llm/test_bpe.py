from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lupafiscal.llm import bpe, words
from lupafiscal.llm.queries import op9_bpe, tokenizer_path
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    return bpe.library(cases.PATH)


def texts():
    rng = random.Random(9)
    letters = "abcdeéüßñ'’ .,!0123²½ªſ\t\n-_<>|"
    out = cases.odd_texts() + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    return [*out, "'s'S'll'LL're'Ve 'm'd", "don''t x'", "'", "é" * 300, cases.prose(4, 40_000)]


def test_same_as_the_library(spark, library):
    rows = list(enumerate(texts()))
    coded = bpe.encode_decode(cases.documents(spark, rows), cases.PATH, keep=("doc_id", "n"))
    got = {r.doc_id: (r.n, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in coded.collect()}
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (2, len(ids), ids, library.decode(ids, skip_special_tokens=False)), text


def test_every_word_of_the_documents(spark, library):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in frame.collect()}
    for row in op9_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(rows[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_words_of_all_texts_but_special_ones_go_through_the_trie(library):
    rng = random.Random(10)
    letters = "aB'“”’—–… \u00a0\u0085\u3000ΑάΣςпривЙ中文字كش😀👩\u200d1²½٣İıſẞe\u0301\u212b<|>sS"
    rows = ["“Quoted” — it’s Ελληνικά, Привет 中文 naïve\u00a0cafe\u0301 😀 <| walk", "", "plain walk", "\u3000", "<|", "İ"]
    rows += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    rows += ["“a”<|endoftext|>ß Привет", "x <|startoftext|>"]
    seen, trie = [], bpe.trie_encoder(cases.PATH).encode_words
    encoder = bpe.Encoder(cases.PATH, lambda own: seen.extend(own) or trie(own))
    for some in (rows, rows[:6], rows[3:4], rows[-2:], ["a", "×!", "\u05e1"]):
        texts = next(iter(words.slices(pa.array(some, pa.string()))))
        flat, at = encoder.ids(texts)
        assert [x.tolist() for x in np.split(flat, at[1:-1])] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert {"“", "”", "—", "ελληνικά", "привет", "中文", "café", "😀", "<|", "walk"} <= set(seen)


def test_trie_shares_prefixes_and_keeps_order(library):
    trie = bpe.Trie(cases.PATH)
    words = ["walking", "walk", "walked", "zebra", "walk", "wal", "é"]
    assert trie.encode(words) == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_other_splitting_is_refused():
    with pytest.raises(ValueError):
        bpe.Trie(tokenizer_path("byte_bpe_50k.json"))


def test_empty_table(spark):
    assert bpe.encode_decode(cases.documents(spark, []), cases.PATH).count() == 0
