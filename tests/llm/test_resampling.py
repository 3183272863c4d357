from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lupafiscal.llm import resampling, words
from tests.llm import cases


def features_of(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.UPPER_TO_LOWER))
    return own, [zlib.crc32(" ".join(own[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(own) - k + 1)]


def brute_force(documents, target):
    corpus = Counter(b for _, text in documents for b in features_of(text)[1])
    wanted = Counter(b for _, text in target for b in features_of(text)[1])
    total, own = sum(corpus.values()), sum(wanted.values())
    gain = [
        math.floor(1000 * math.log((wanted[b] + 1) * (total + 10_000) / ((corpus[b] + 1) * (own + 10_000))))
        for b in range(10_000)
    ]
    out = []
    for doc_id, text in documents:
        found, buckets = features_of(text)
        weight = sum(gain[b] for b in buckets)
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(buckets), weight, score, None, len(found) >= 20])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(order[: 5 * len(order) // 100], 1):
        r[4] = rank
    return out


def rows():
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, cases.prose(i, 10 + i % 60)) for i in range(400)]
    out += [(600, "z" * 300 + " " + "y" * 64 + " " + "x" * 65 + " Ä" * 40), (600, "z" * 300), (None, cases.prose(9, 50))]
    out += [(700, cases.prose(3, 30_000)), (701, cases.prose(1, 50).upper())]
    return out


def target():
    return [(i, cases.prose(1000 + i, 30, 40)) for i in range(40)] + [(7, None)]


@pytest.mark.parametrize("keys, segments", [(1 << 14, None), (64, 9), (1 << 14, 40)])
def test_as_by_plain_python(spark, monkeypatch, keys, segments):
    monkeypatch.setattr(resampling, "SAMPLE_KEYS", keys)
    if segments:
        drawn = resampling.drawn
        monkeypatch.setattr(resampling, "drawn", lambda df, percent: drawn(df, percent, segments))
    found = resampling.resample(cases.documents(spark, rows()), cases.documents(spark, target())).collect()
    got = sorted(map(str, ([r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.eligible] for r in found)))
    assert got == sorted(map(str, brute_force(rows(), target())))


def test_many_equal_keys_are_ranked_each_once(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SAMPLE_KEYS", 256)
    rng = random.Random(1)
    data = [(1, 50)] * 1500 + [(None, 50)] * 300 + [(i, rng.choice([10, 50, 90])) for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, score long").withColumn("eligible", F.lit(True)).repartition(5)
    found = resampling.drawn(df, 60, segments=16).collect()
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert len(found) == 3000 and [r["rank"] for r in ranked] == list(range(1, 1801))
    order = sorted(data, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r.doc_id, r.score) for r in ranked] == order[:1800]
    # Equal keys are split over segments: none holds a third of the rows.
    runs = df.withColumn("place", F.monotonically_increasing_id())
    sizes = resampling._with_segments(runs, resampling.splitters(runs, 3000, 16)).groupBy("segment").count().collect()
    assert max(r["count"] for r in sizes) < 1000


def test_buckets_are_those_of_crc32():
    import pyarrow as pa

    text = "A bb " + "c" * 200 + " ddd é " + "e" * 65
    (texts,) = words.slices(pa.array([text, "", "one"]))
    own, found = resampling.features(texts)
    want = [[zlib.crc32(" ".join(x).encode()) % 10_000 for x in zip(*(features_of(text)[0][j:] for j in range(k)))] for k in (1, 2, 3)]
    want[0].append(zlib.crc32(b"one") % 10_000)
    assert [b.tolist() for _, b in found] == want


def test_empty_tables(spark):
    assert resampling.resample(cases.documents(spark, []), cases.documents(spark, target())).count() == 0
    alone = resampling.resample(cases.documents(spark, rows()), cases.documents(spark, [])).collect()
    assert sorted(str(r.weight) for r in alone) == sorted(str(r[2]) for r in brute_force(rows(), []))
