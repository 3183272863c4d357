from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lupafiscal.llm import ngram_join
from tests.llm import cases


def shingles(text):
    own = cases.words_of((text or "").translate(cases.UPPER_TO_LOWER))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))


def brute_force(rows):
    """(doc_id, class_id, n_links) of each row, by comparing all rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def edited(text, *places):
    own = text.split()
    for p in places:
        own[p] = f"edit{p}"
    return " ".join(own)


def rows():
    out = list(enumerate(cases.odd_texts()))
    base = cases.prose(1, 120)
    out += [(100 + i, edited(base, 3 * i % 120)) for i in range(40)]
    out += [(200 + i, base) for i in range(30)]
    out += [(300, edited(base, *range(0, 120, 4))), (301, base.upper()), (301, base.upper()), (None, base), (None, None)]
    out += [(400 + i, cases.prose(50 + i, 60)) for i in range(20)]
    chain = cases.prose(2, 200)
    out += [(500 + i, edited(chain, *range(0, 3 * i, 3))) for i in range(12)]
    out.append((600, cases.prose(3, 30_000)))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_same_as_comparing_all(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    found = ngram_join.near_duplicates(cases.documents(spark, rows())).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute_force(rows())


@pytest.mark.parametrize("shingles", [100, 400])
def test_blocks_of_few_shingles_may_be_empty(spark, monkeypatch, shingles):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    found = ngram_join.near_duplicates(cases.documents(spark, rows())).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute_force(rows())


def test_one_of_each(spark):
    df = cases.documents(spark, rows())
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    want = {(d, c) for d, c, _ in brute_force(rows())}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {d for d, c in want if d == c}
    assert ids.count(301) == 0 and len(ids) == len(set(ids))


def test_empty_table(spark):
    assert ngram_join.near_duplicates(cases.documents(spark, [])).count() == 0


def test_common_counts_both_ways(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:30]]
    for limit in (2, 16, 10_000):
        monkeypatch.setattr(ngram_join, "DENSE_FROM", limit)
        assert ngram_join.common(sets[:30], sets[30:]).tolist() == want


def test_bands_reach_the_recall():
    bands, band_rows = ngram_join.bands_for(0.8, 0.9999, 200)
    assert bands * band_rows <= 200
    assert 1 - (1 - 0.8**band_rows) ** bands >= 0.9999
