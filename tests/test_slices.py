"""Even key ranges hold every row once."""

from __future__ import annotations

import datetime as dt
import statistics

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lupafiscal.schemas import PRIMARY_KEYS, SCHEMAS
from lupafiscal.sources import jdbc, slices
from tests import tables

KEYS = st.one_of(
    st.lists(st.one_of(st.none(), st.integers(-(2**60), 2**60))),
    st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=5))),
    st.lists(st.one_of(st.none(), st.dates(dt.date(1900, 1, 1), dt.date(2100, 1, 1)))),
)


@given(KEYS, st.integers(1, 9), st.data())
def test_ranges_hold_every_key_once(keys, count, data):
    """As a database compares them, by the SQL it is sent; the sample may have missed most keys."""
    known = sorted({k for k in keys if k is not None})
    sample = sorted(data.draw(st.lists(st.sampled_from(known)))) if known else []
    cut = slices.ranges("k", sample, count)
    assert 1 <= len(cut) <= count
    con = duckdb.connect()
    kind = {int: "BIGINT", str: "VARCHAR", dt.date: "DATE"}[type(known[0])] if known else "BIGINT"
    con.execute(f"CREATE TABLE t (k {kind})")
    for key in keys:
        con.execute("INSERT INTO t VALUES (?)", [key])
    counts = [con.execute(f"SELECT COUNT(*) FROM t WHERE {part.sql()}").fetchone()[0] for part in cut]
    assert sum(counts) == len(keys)


@pytest.mark.parametrize("case", ["hand-made", "random", "dirty"])
def test_every_table_is_covered_once(spark, case):
    """The same over DataFrames, as conditions and as SQL texts."""
    rows = {"hand-made": tables.hand_made(), "random": tables.random_tables(3, 50), "dirty": tables.dirty_tables()}[case]
    audit = tables.audit(spark, rows)
    for name in SCHEMAS:
        keys = audit.table(name, PRIMARY_KEYS[name])
        cut = slices.balanced(keys, PRIMARY_KEYS[name], 5)
        once = sum((part.condition().cast("int") for part in cut), F.lit(0))
        as_sql = sum((F.coalesce(F.expr(part.sql()), F.lit(False)).cast("int") for part in cut), F.lit(0))
        assert keys.filter((once != 1) | (as_sql != 1)).count() == 0
        assert sum(r.linhas for r in slices.sizes(keys, cut).collect()) == len(rows[name])


@pytest.mark.parametrize("text", [False, True])
def test_skewed_keys_give_even_slices(spark, text):
    """Nine tenths of the keys lie in a thousandth of their range."""
    n = F.col("id")
    key = F.when(n % 10 == 0, n * 1_000_000).otherwise(n)
    key = F.concat(F.lit("PGT-"), F.lpad(key.cast("string"), 14, "0")) if text else key
    rows = spark.range(200_000).select(key.alias("k"))
    cut = slices.balanced(rows, "k", 32)
    counts = [r.linhas for r in slices.sizes(rows, cut).collect()]
    assert sum(counts) == 200_000 and len(counts) == 32
    assert max(counts) <= 2 * statistics.median(counts)


def test_a_key_that_repeats_is_one_slice(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("k"))
    counts = [r.linhas for r in slices.sizes(rows, slices.balanced(rows, "k", 8)).collect()]
    assert sum(counts) == 1000 and max(counts) <= 700 + 2 * 1000 // 8


def test_database_is_asked_for_keys_in_its_own_order(monkeypatch):
    """The questions, answered by a stand-in for the session; no database is run."""
    asked = []

    class Reader:
        def format(self, _):
            return self

        def options(self, url, query, **_):
            asked.append(query)
            return self

        def load(self):
            return self

        def first(self):
            return {"n": 10**9}

        def collect(self):
            return [{"slice_key": key, "place": place} for place, key in ((3, "B"), (1, "a"), (2, "b"), (4, "c'"))]

    session = type("Session", (), {"read": Reader()})
    parts = jdbc.find_predicates(session, "jdbc:x", {}, 4)
    assert set(parts) == set(SCHEMAS)
    assert parts["nfe_pagamento"] == ["(id < 'b' OR id IS NULL)", "id >= 'b' AND id < 'B'", "id >= 'B' AND id < 'c'''", "id >= 'c'''"]
    assert "FROM nfe_pagamento TABLESAMPLE BERNOULLI (0.001638) WHERE id IS NOT NULL" in " ".join(asked)
    assert "TABLESAMPLE" not in jdbc.sample_query("nfe", 100.0)
