from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lupafiscal.llm import periodic_runs
from tests.llm import cases


def brute_force(own):
    """All runs of a list of words, by trying every period from the smallest on."""
    n, found = len(own), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if own[i] != own[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and own[j] == own[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(own, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(own) if i not in gone)


def periodic(doc_id, text):
    own = cases.words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not own:
        return own
    g, n = h // 10, len(own)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]


def test_as_by_trying_all_periods_on_many_small_texts():
    rng = random.Random(5)
    texts = []
    for k in range(3000):
        alphabet = rng.choice([1, 2, 2, 3, 5])
        unit = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 9))]
        own = [rng.randrange(alphabet) for _ in range(rng.randrange(0, 12))]
        own += unit * rng.randrange(0, 12) + unit[: rng.randrange(len(unit))]
        own += [rng.randrange(alphabet) for _ in range(rng.randrange(0, 30))]
        own += unit * rng.randrange(0, 6) + own[: rng.randrange(20)] * rng.randrange(1, 5)
        texts.append(own)
    ids = np.array([w for own in texts for w in own], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in texts])])
    row, start, length, period = periodic_runs.runs(ids, offsets)
    got = {}
    for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got.setdefault(r, []).append(tuple(run))
    for k, own in enumerate(texts):
        assert sorted(got.get(k, [])) == brute_force(own), own


@pytest.mark.parametrize("unit, times", [([1], 200_000), ([1, 1, 2], 60_000), (list(range(1000)), 150)])
def test_long_texts_take_time_in_proportion(unit, times):
    ids = np.array([9, *unit * times, 8], np.int64)
    row, start, length, period = periodic_runs.runs(ids, np.array([0, len(ids)]))
    whole = length.argmax()
    assert (start[whole], length[whole], period[whole]) == (1, len(unit) * times, len(unit))


def rows():
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, cases.prose(i, 3 * i, 7)) for i in range(150)]
    out += [(300 + i, f"{cases.prose(i, 9)} {' '.join([cases.prose(i, i % 11 + 1, 3)] * (i % 9))} {cases.prose(i + 1, 9)}") for i in range(100)]
    out += [(500, "same " * 30_000), (501, "a b " * 50), (502, " a\tb\n" * 4), (502, " a\tb\n" * 4), (None, "x y z " * 9), (None, None)]
    return out


def test_texts_as_by_plain_python(spark):
    made = periodic_runs.with_planted_runs(cases.documents(spark, rows()))
    found = periodic_runs.collapse(made, keep=("doc_id",)).select("*", periodic_runs.longest().alias("longest")).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.longest and tuple(r.longest)) for r in found
    )
    want = []
    for doc_id, text in rows():
        own = periodic(doc_id, text)
        runs = brute_force(own) if doc_id != 500 else [(0, 30_000, 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((str(doc_id), len(own), sorted(runs, key=lambda r: (r[0], r[2])), collapsed(own, runs), best))
    assert sorted(want) == got


def test_empty_table(spark):
    made = periodic_runs.with_planted_runs(cases.documents(spark, []))
    assert periodic_runs.collapse(made, keep=("doc_id",)).count() == 0


def test_query_digests(spark, tmp_path):
    import hashlib

    from lupafiscal.llm import queries

    cases.documents(spark, rows()).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    for doc_id, text in rows():
        if doc_id in (None, 500, 502):
            continue
        own = periodic(doc_id, text)
        runs = sorted(brute_force(own), key=lambda r: (r[0], r[2]))
        r, listed = got[doc_id], "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(listed.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(own, runs).encode()).hexdigest()
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
