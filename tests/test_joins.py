"""Joins on a key and an order of days make the pairs in order and no others."""

from __future__ import annotations

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lupafiscal import run
from lupafiscal.functions.joins import DAY_BITS, earlier_later
from tests import tables
from tests.test_skew import SMALL_UNITS, skewed


def joined(left, right):
    firsts = left.groupBy("k").agg(F.min("a").alias("first"))
    lasts = right.groupBy("k").agg(F.max("b").alias("last"))
    return earlier_later(left, right, "k", "a", "b", firsts, lasts)


@pytest.mark.parametrize("span", [3, 40, 3000, 3_652_000])
def test_pairs_as_by_comparing_all(spark, span):
    rng = random.Random(span)
    low = dt.date(1, 1, 1) if span > 10_000 else dt.date(2019, 12, 25)

    def side(n):
        rows = [(rng.choice(["x", "y", "z", None]), low + dt.timedelta(rng.randrange(span)), i) for i in range(n)]
        return rows + [("x", None, -1), ("w", low, -2), ("x", dt.date(9999, 12, 31), -3), ("x", dt.date(1, 1, 1), -4)]

    left, right = side(120), side(130)
    found = joined(spark.createDataFrame(left, "k string, a date, i int"), spark.createDataFrame(right, "k string, b date, j int"))
    assert found.columns == ["k", "a", "i", "b", "j"]
    got = sorted((r.i, r.j) for r in found.collect())
    assert got == sorted((i, j) for k, a, i in left for m, b, j in right if k and k == m and a and b and a < b)


def test_bits_hold_every_day():
    assert (dt.date.max - dt.date.min).days < 2**DAY_BITS


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string, a date, i int")
    some = spark.createDataFrame([("x", dt.date(2024, 1, 1), 1)], "k string, b date, j int")
    assert joined(none, some).count() == 0


def hot(spark, n):
    """One commitment: n payments after n liquidations, but for ten later ones."""
    day = lambda c: F.date_add(F.lit(tables.DAY0), c.cast("int"))
    rows = spark.range(0, n, 1, 4)
    left = rows.select(F.lit("E0").alias("k"), day(1000 + F.col("id") % 500).alias("a"), F.col("id").alias("i"))
    right = rows.select(F.lit("E0").alias("k"), day(F.when(F.col("id") < 10, 1490).otherwise(F.col("id") % 1000)).alias("b"),
                        F.col("id").alias("j"))
    return left, right


def test_time_follows_rows_and_result_not_their_product(spark, settings):
    """160,000 rows a side are 25.6 billion pairs, and 1.6 million in order."""
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    left, right = hot(spark, 160_000)
    begin = time.monotonic()
    n = joined(left, right).count()
    assert n == 10 * left.filter(F.col("a") < F.date_add(F.lit(tables.DAY0), 1490)).count()
    assert time.monotonic() - begin < 60


def test_advances_are_joined_by_equality_alone(spark, settings):
    settings(SMALL_UNITS)
    text = run("g13_irregular_advances", skewed(spark))._jdf.queryExecution().executedPlan().toString()
    (line,) = [x for x in text.splitlines() if "Join" in x and "_range" in x]
    assert not re.search(r"data_pagamento#\d+ < data_liquidacao", text)
    assert "Inner" in line and "<" not in line
