from __future__ import annotations

import pytest

from lupafiscal.llm import suffix_dedup
from tests.llm import cases


def brute_force(rows):
    owners, out = {}, {}
    for key in set(rows):
        own = cases.words_of(key[1])
        for i in range(len(own) - 49):
            owners.setdefault(tuple(own[i : i + 50]), set()).add(key)
    for key in set(rows):
        own = cases.words_of(key[1])
        hit = set()
        for i in range(len(own) - 49):
            if len(owners[tuple(own[i : i + 50])]) > 1:
                hit.update(range(i, i + 50))
        out[key] = hit
    return out


def rows():
    passage = cases.prose(1, 60)
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, f"{cases.prose(100 + i, 30 + i)} {passage} {cases.prose(200 + i, 40)}") for i in range(25)]
    words = passage.split()
    out += [(200 + i, f"{cases.prose(300 + i, 20)} {' '.join(words[i : i + 51])} {cases.prose(400 + i, 20)}") for i in range(8)]
    out += [(300, " ".join(words[:49])), (301, " ".join(words[:50])), (302, passage), (303, passage), (303, passage), (None, passage)]
    left, right = cases.prose(500, 40), cases.prose(501, 40)
    core = cases.prose(502, 25)
    # Three texts around one anchor: some share what precedes it, others what follows.
    out += [(400, f"{left} {core} {cases.prose(503, 40)}"), (401, f"{left} {core} {cases.prose(504, 40)}"), (402, f"{cases.prose(505, 40)} {core} {right}"), (403, f"{cases.prose(506, 40)} {core} {right}")]
    out += [(500, "same " * 300), (501, "same " * 70), (502, f"{cases.prose(600, 80)} x {cases.prose(600, 80)}"), (503, cases.prose(7, 20_000))]
    return out


@pytest.mark.parametrize("together", [4096, 5])
def test_same_as_comparing_all_windows(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    found = suffix_dedup.repeated_passages(cases.documents(spark, rows())).collect()
    want = brute_force(rows())
    assert len(found) == len(rows())
    got = sorted((str(r.doc_id), r.n_repeated, sorted(w for s in r.spans for w in range(s.first, s.last))) for r in found)
    assert got == sorted((str(d), len(want[d, t]), sorted(want[d, t])) for d, t in rows())


def test_repeats_within_one_document_do_not_count(spark):
    text = f"{cases.prose(1, 80)} x {cases.prose(1, 80)}"
    found = suffix_dedup.repeated_passages(cases.documents(spark, [(1, text), (2, cases.prose(2, 90))])).collect()
    assert [r.n_repeated for r in found] == [0, 0]


def test_empty_table(spark):
    assert suffix_dedup.repeated_passages(cases.documents(spark, [])).count() == 0
