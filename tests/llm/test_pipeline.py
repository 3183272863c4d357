"""The pipeline against plain Python, stage by stage on what each one gets."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lupafiscal.llm import bpe, quality
from lupafiscal.llm.tables import written
from tests.llm import cases
from tests.llm.test_decontamination import PASSAGE
from tests.llm.test_decontamination import brute_force as contamination
from tests.llm.test_line_dedup import brute_force as line_groups
from tests.llm.test_ngram_join import brute_force as near_duplicates


def rows():
    base = cases.prose(1, 150)
    words = base.split()
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, cases.prose(100 + i, 80)) for i in range(20)]
    out += [(200, base), (201, base), (202, " ".join([*words[:70], "new", *words[71:]])), (203, " ".join(words[i] for i in range(150) if i != 9))]
    # Lines end at other places, so that only whole documents are alike.
    out += [(210, cases.prose(2, 120)), (211, "\n".join(" ".join(cases.prose(2, 120).split()[i : i + 40]) for i in (0, 40, 80)))]
    out += [(300, f"{PASSAGE} {cases.prose(300, 60)}"), (301, f"{cases.prose(301, 400)} {PASSAGE}"), (302, "word " * 90)]
    out += [(303, f"{cases.prose(303, 60)}\nAll rights reserved, as always.\n\nmore"), (304, f"{cases.prose(304, 60)}\nAll rights reserved, as always.")]
    return [*out, (305, cases.prose(305, 60)), (305, cases.prose(305, 60)), (None, cases.prose(306, 60)), (306, cases.prose(1, 20_000))]


@pytest.fixture
def folder(spark, tmp_path):
    cases.documents(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(20)] + [(302, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, PASSAGE), (2, None), (None, "of no use here at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        docs = written(stage(spark, docs, folder), name)
        if name != "bpe":
            assert docs.columns == columns
            after = pairs(docs)
        if name == "quality_rules":
            model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            scored = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), model, keep=("doc_id", "text")).collect()
            assert after == sorted(((r.doc_id, r.text) for r in scored if r.kept), key=str)
            assert {d for d, _ in before} - {d for d, _ in after} >= {0, 1, 2, 302}
            assert {d for d, _ in after} >= {200, 201, 303, 305, None}
        elif name == "line_dedup":
            lines, group, _ = line_groups(before)
            assert sum(line in lines for _, t in after for line in (t or "").split("\n")) >= len(set(group))
            texts = dict(after)
            assert 201 not in texts and 202 not in texts and 200 in texts
            assert texts[304].endswith(cases.prose(304, 60)) and "All rights" in texts[303]
        elif name == "ngram_join":
            kept = {d: c for d, c, _ in near_duplicates(before)}
            assert {d for d, _ in after} == {d for d, c in kept.items() if d == c}
            assert 210 in kept and 211 not in dict(after)
            assert set(after) <= set(before)
        elif name == "decontamination":
            def clean(text):
                n, hit, _ = contamination(text, [("1", PASSAGE), ("", "of no use here at all")])
                return not hit or 20 * hit < n

            assert after == [x for x in before if clean(x[1])]
            assert 300 not in dict(after) and 301 in dict(after)
        else:
            library = bpe.library(cases.PATH)
            got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect()), key=str)
            want = []
            for d, text in before:
                ids = library.encode(text, add_special_tokens=False).ids
                want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
            assert got == sorted(want, key=str)


def test_run_is_the_stages_in_turn(spark, folder):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert {200, 301, 303, 304, 305, None} <= ids and not ids & {0, 201, 202, 211, 300, 302}


def test_empty_documents(spark, folder, tmp_path_factory):
    empty = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
