from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lupafiscal.llm import class_model, words
from tests.llm import cases

END = object()


def tokens_of(text):
    return [*cases.words_of((text or "").translate(cases.UPPER_TO_LOWER)), END]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def unit_of(model, token):
    (texts,) = words.slices(pa.array(["" if token is END else token]))
    found = class_model.tokens(texts)
    return int(model.lexicon.units(found)[0][found.ids[0]])


def brute_force(rows, model):
    """Scores by the model's classes, all else counted anew."""
    training = [tokens_of(text) for doc_id, text in rows if not held_out(doc_id)]
    count = Counter(t for text in training for t in text)
    total, distinct = sum(count.values()), len(count)
    class_of = {t: int(model.classes[unit_of(model, t)]) for _, text in rows for t in tokens_of(text)}
    pairs, size, members = defaultdict(int), Counter(), Counter(class_of[t] for t in count)
    for text in training:
        for a, b in zip([END, *text], text, strict=False):
            pairs[class_of[a], class_of[b]] += 1
            size[class_of[b]] += 1
    after = Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    out = []
    for doc_id, text in rows:
        own = tokens_of(text)
        base = score = 0.0
        for a, b in zip([END, *own], own, strict=False):
            base += math.log10((count[b] + 1) / (total + distinct + 1))
            f, g = class_of[a], class_of[b]
            share = (size[g] + 1) / (total + 65)
            score += math.log10((pairs[f, g] + 16 * share) / (after[f] + 16))
            if b is not END:
                score += math.log10((count[b] + 1) / (size[g] + members[g] + 1))
        out.append((doc_id, held_out(doc_id), len(own), sum(count[t] > 0 for t in own), total, base, score))
    return out


def sentences(seed, n):
    """Text with classes of words in it: articles, names, verbs, names."""
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        made += [rng.choice(["the", "a", "this"]), f"noun{int(rng.paretovariate(0.7)) % 300}", f"verb{int(rng.paretovariate(0.8)) % 90}"]
        made += [rng.choice(["the", "some"]), f"noun{int(rng.paretovariate(0.7)) % 300}."]
    return " ".join(made)


def rows():
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, sentences(i, 5 + i % 40)) for i in range(150)]
    out += [(400, "THE The the"), (400, "THE The the"), (None, sentences(9, 5)), (None, None), (500, cases.prose(1, 20_000))]
    return out


@pytest.mark.parametrize("shares", [(2**-16, 2**-20), (2**-7, 2**-9)])
def test_scores_as_by_plain_python(spark, monkeypatch, shares):
    monkeypatch.setattr(class_model, "UNIT_SHARE", shares[0])
    monkeypatch.setattr(class_model, "KNOWN_SHARE", shares[1])
    prepared = class_model.prepared(cases.documents(spark, rows()))
    model, vocab = class_model.fit(prepared.filter("not held_out"))
    found = class_model.score(prepared, model, vocab).collect()
    got = sorted(((str(r.doc_id), *r[1:]) for r in found), key=lambda r: (r[0], r[5]))
    want = sorted(((str(r[0]), *r[1:]) for r in brute_force(rows(), model)), key=lambda r: (r[0], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_classes_predict_held_out_texts_better_than_words_alone(spark):
    data = [(i, sentences(i, 60)) for i in range(300)]
    found = class_model.scored(cases.documents(spark, data)).filter("held_out").collect()
    n = sum(r.n_tokens for r in found)
    base, own = (10 ** (-sum(r[c] for r in found) / n) for c in ("base_score", "score"))
    assert own < 0.5 * base


def test_gain_is_the_change_of_the_likelihood(monkeypatch):
    rng = np.random.default_rng(4)
    units = 30
    n = rng.integers(0, 9, (units, units)).astype(float)
    n[:, 0], n[0, :] = 3, 3
    # Every unit comes as often as it is followed.
    n[:, 0] += np.maximum(n.sum(axis=0) - n.sum(axis=1), 0)
    n[0, :] += np.maximum(n.sum(axis=1) - n.sum(axis=0), 0)
    classes = np.concatenate([[0], 1 + np.arange(units - 1) % 5])

    def table(of):
        out = np.zeros((65, 65))
        np.add.at(out, (of[:, None], of[None, :]), n)
        return out

    m = table(classes)
    for unit in range(1, units):
        others = np.arange(units) != unit
        left, right = (np.bincount(classes[others], weights=x[others], minlength=65) for x in (n[:, unit], n[unit, :]))
        value = class_model.gains(m, classes[unit], left, right, n[unit, unit])
        for to in range(1, 6):
            moved = classes.copy()
            moved[unit] = to
            assert math.isclose(value[to], class_model.likelihood(table(moved)) - class_model.likelihood(m), abs_tol=1e-6)


def test_exchange_raises_the_likelihood(spark):
    rows = class_model.prepared(cases.documents(spark, [(i, sentences(i, 60)) for i in range(100)]))
    known = class_model.lexicon(class_model.vocabulary(rows))
    beside = class_model.neighbours(class_model.bigrams(rows, known)).persist()
    start, end = (class_model.likelihood(class_model.exchange(beside, known.n_units, rounds)[1]) for rounds in (0, 16))
    beside.unpersist()
    assert end > start


def test_empty_table_and_no_training(spark):
    assert class_model.scored(cases.documents(spark, [])).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    (r,) = class_model.scored(cases.documents(spark, [(alone, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
