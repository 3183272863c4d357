"""Sets of integers compared as bitmaps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lupafiscal.functions import bitmaps


@pytest.mark.parametrize("spread", [50, 40_000, 2**40])
def test_missing_as_by_sets(spark, spread):
    r = random.Random(spread)
    edges = [0, 1, -1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, 65_536, 2**62, -(2**62)]
    keys = [r.randrange(-spread, spread) for _ in range(400)] + edges
    children = [r.choice(keys) if r.random() < 0.8 else r.randrange(-spread, spread) for _ in range(600)] + edges + [None] * 5
    known = [k for k in keys if r.random() < 0.9] + [None]
    found = bitmaps.missing(
        spark.createDataFrame([(x,) for x in children], "c long"), "c", spark.createDataFrame([(x,) for x in known], "p long"), "p")
    assert sorted(row.c for row in found.collect()) == sorted(x for x in children if x is not None and x not in set(known))


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "c long"), spark.createDataFrame([(7,), (7,)], "c long")
    assert bitmaps.missing(none, "c", some, "c").count() == 0
    assert [r.c for r in bitmaps.missing(some, "c", none, "c").collect()] == [7, 7]


def test_sound_references_shuffle_bitmaps_not_keys(spark):
    """100,000 values are five bitmaps; the rows are read again beside the open ranges, of which there are none."""
    children = spark.range(0, 200_000, 1, 4).select((F.col("id") % 100_000).alias("c"))
    parents = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("p"))

    found = bitmaps.missing(children, "c", parents, "p")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert found.count() == 0
    ranges = bitmaps.by_range(children, "c")
    assert ranges.count() == 5 and ranges.agg(F.sum(F.bitmap_count("bits"))).first()[0] == 100_000
