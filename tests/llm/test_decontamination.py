from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lupafiscal.llm import decontamination
from tests.llm import cases


def brute_force(text, items):
    own = decontamination.words_of(text)
    hit, found = [False] * len(own), set()
    for item, phrase in items:
        p = decontamination.words_of(phrase)
        size = min(13, len(p))
        windows = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if p else set()
        for i in range(len(own) - size + 1):
            if p and tuple(own[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
                found.add(item)
    return len(own), sum(hit), sorted(found)


ITEMS = [
    (1, "One TWO three four five six seven eight nine ten eleven twelve thirteen fourteen, fifteen!"),
    (2, "short item"), (3, ""), (4, None), (5, "... !!"), (None, "nobody knows this"), (6, "aa aa aa aa"),
    (7, "three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "another short one"),
    (8, "ünï cödé"),
]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def rows():
    rng = random.Random(3)
    out = list(enumerate(cases.odd_texts()))
    vocabulary = [*PASSAGE.split(), "short", "item", "aa", "zz", "Aa", "nobody", "knows", "this", "ünï", "cödé"]
    out += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(80)]
    out += [(200, f"before {PASSAGE.upper()} after"), (201, PASSAGE), (201, PASSAGE), (None, PASSAGE)]
    out += [(202, "aa " * 50), (203, f"{cases.prose(1, 20000)} {PASSAGE} {cases.prose(2, 20000)}"), (204, "x-short?item.y")]
    return out


def found(spark, items, documents):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, t string")
    return decontamination.find(cases.documents(spark, documents), benchmark, keep=("doc_id", "text", "n_words"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_same_as_searching_each_window(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    df = found(spark, ITEMS, rows())
    got = sorted(
        ((r.doc_id, r.text, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str
    )
    named = [(str(i) if i is not None else "", t) for i, t in ITEMS]
    want = sorted(((d, t, *brute_force(t, named)) for d, t in rows()), key=str)
    assert got == want


def test_removals_cut_the_passages(spark):
    df = found(spark, ITEMS, [(1, f"É before, {PASSAGE.upper()}; after"), (2, None)])
    cut = {r.doc_id: r.rest for r in df.select("doc_id", decontamination.without(F.col("text"), F.col("removals")).alias("rest")).collect()}
    assert cut == {1: "É before, ; after", 2: None}


def test_verdict(spark):
    long = cases.prose(1, 286)
    df = found(spark, ITEMS, [(1, f"{PASSAGE} {long[:-1]}"), (2, f"{PASSAGE} {long}"), (3, f"{PASSAGE} zz {long}"), (4, "")])
    assert {r.doc_id for r in df.filter(decontamination.contaminated()).collect()} <= {1, 2}
    for row in df.withColumn("bad", decontamination.contaminated()).collect():
        assert row.bad == (row.n_hit > 0 and 20 * row.n_hit >= row.n_words)


def test_empty_tables(spark):
    assert found(spark, ITEMS, []).count() == 0
    (row,) = found(spark, [], [(1, PASSAGE)]).collect()
    assert row.n_hit == 0 and row["items"] == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(7)
    text = rng.integers(0, 4, 3000)
    text = np.append(text[(text > 0) | (np.roll(text, 1) > 0)], 0).astype(np.int32)
    text[0] = 1
    index = decontamination.FmIndex(text, 3)
    order = decontamination.suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    phrases = np.array([[0, 0, 1], [0, 2, 3], [1, 1, 1], [3, 2, 1]])
    which, low, high = index.search(phrases, np.array([1, 2, 3, 3]))
    for w, a, b in zip(which, low, high, strict=True):
        phrase = phrases[w][phrases[w] > 0].tolist()
        want = [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
