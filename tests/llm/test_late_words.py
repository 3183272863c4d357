"""Words without a unit of their own: every one has a class by its own neighbours."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lupafiscal.llm import class_model, words
from tests.llm import cases


def unit_of(model, token):
    (texts,) = words.slices(pa.array([token]))
    found = class_model.tokens(texts)
    units = model.lexicon.units(found)[0]
    return int(units[found.keys != class_model.END][0])


@pytest.mark.parametrize("shares", [(2**-6, 2**-20), (2**-6, 2**-6)])
def test_rare_words_of_one_shape_part_by_what_is_around_them(spark, monkeypatch, shares):
    """Held by the tasks, or joined."""
    monkeypatch.setattr(class_model, "UNIT_SHARE", shares[0])
    monkeypatch.setattr(class_model, "KNOWN_SHARE", shares[1])
    rng = random.Random(3)
    names = {kind: [f"{kind}{i:04d}zz" for i in range(60)] for kind in "xy"}
    data = []
    for i in range(200):
        parts = []
        for _ in range(12):
            often, (kind, before, after) = rng.random() < 0.5, rng.choice([("x", "the", "sees"), ("y", "we", "now")])
            parts.append(f"{before} {kind if often else rng.choice(names[kind])} {after}")
        data.append((i, " ".join(parts)))
    model, _ = class_model.fit(class_model.prepared(cases.documents(spark, data)).filter("not held_out"))
    classes = {kind: {int(model.classes[unit_of(model, word)]) for word in names[kind]} for kind in names}
    assert not classes["x"] & classes["y"]


def test_best_classes_as_by_gains():
    rng = np.random.default_rng(5)
    m = rng.integers(0, 400, (65, 65)).astype(float) * (rng.random((65, 65)) < 0.6)
    own = rng.integers(1, 65, 300)
    beside = rng.integers(1, 9, (2, 300, 65)).astype(float) * (rng.random((2, 300, 65)) < 0.05)
    itself = rng.integers(0, 3, 300).astype(float)
    # What a unit has beside it is among the counts.
    for g in range(300):
        m[:, own[g]] += beside[0, g]
        m[own[g], :] += beside[1, g]
        m[own[g], own[g]] += itself[g]
    found = class_model.best_classes(m, own, beside, itself)
    for g in range(300):
        value = class_model.gains(m, int(own[g]), beside[0, g], beside[1, g], itself[g])
        best = int(value.argmax())
        assert found[g] == (best if value[best] > 1e-6 else own[g])


def test_contexts_add_up_over_batches(spark, settings, monkeypatch):
    """A word's rows may lie in several batches, and it may follow itself."""
    settings({"spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    monkeypatch.setattr(class_model, "CONTEXT_BYTES", 64)
    data = [(i, cases.prose(i, 80, vocabulary=30) + " w1 w1 w1") for i in range(60)] + [(90, None), (91, "alone")]
    rows = class_model.prepared(cases.documents(spark, data))
    monkeypatch.setattr(class_model, "UNIT_SHARE", 2**-5)
    known = class_model.lexicon(class_model.vocabulary(rows))
    classes = np.concatenate([[0], 1 + np.arange(known.n_units - 1 + class_model.SHAPES) % 64])
    beside = class_model.neighbours(class_model.bigrams(rows, known)).persist()
    m = class_model.transitions(beside, classes)
    beside.unpersist()
    late = class_model.late_classes(class_model.contexts(rows, known, classes), m).collect()
    want = {}
    for _, text in data:
        own = [class_model.END, *(t for t in cases.words_of(text)), class_model.END]
        for before, now, after in zip(own, own[1:], own[2:], strict=False):
            want.setdefault(now, []).append((before, after))

    def found(token):
        if token is class_model.END:
            return 0, 0, True
        (texts,) = words.slices(pa.array([token]))
        t = class_model.tokens(texts)
        (i,) = np.flatnonzero(t.keys != class_model.END)
        unit = int(known.units(t)[0][i])
        return int(t.keys[i].astype(np.int64)), int(classes[unit]), unit < known.n_units

    expected = []
    for token, around in want.items():
        word, own, early = found(token)
        if early:
            continue
        sides = [np.bincount([found(x[k])[1] for x in around if x[k] != token], minlength=65) for k in (0, 1)]
        value = class_model.gains(m, own, *sides, float(sum(x[0] == token for x in around)))
        best = int(value.argmax())
        expected.append((word, len(around), own, best if value[best] > 1e-6 else own))
    assert len(expected) > 10
    assert sorted(tuple(r) for r in late) == sorted(expected)
