"""Tables laid out by commitment: the same rows, and payments stay where they lie."""

from __future__ import annotations

import re

import pytest

from lupafiscal import CHECKS, run
from lupafiscal.sources import bucketed
from tests import tables

BUCKETS = 4
CASE = tables.random_tables(seed=11, size=80)


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bucketed") / "tables")
    bucketed.write_tables(tables.audit(spark, CASE), root, BUCKETS)
    return bucketed.open_audit(spark, root, BUCKETS), tables.database(CASE)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def above(lines: list[str], scan: int) -> list[str]:
    """The operators that a scan's rows go through."""
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    level, out = depth[scan], []
    for i in range(scan - 1, -1, -1):
        if depth[i] < level:
            level = depth[i]
            out.append(lines[i])
    return out


@pytest.mark.parametrize("key", ["q17", "q18", "q19", "q24", "q30", "q30b", "m01", "g04", "q16", "c02"])
def test_same_rows(pair, key):
    audit, con = pair
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    assert tables.rows_of(run(name, audit)) == tables.rows_of_sql(con, name)


@pytest.mark.parametrize("key", ["q17", "q30", "m01"])
def test_payments_are_not_moved(pair, settings, key):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
    audit, _ = pair
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    lines = plan(run(name, audit))
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "lupafiscal_pagamento" in line]
    assert scans and all("Bucketed: true" in lines[i] for i in scans)
    for i in scans:
        way = above(lines, i)
        joined = next(k for k, line in enumerate(way) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in way[:joined])
        moved = [line for line in way if "Exchange hashpartitioning(id_empenho" in line]
        assert not moved


def test_one_sorted_file_for_each_bucket(pair, spark, settings):
    audit, _ = pair
    files = audit.table("pagamento").inputFiles()
    assert len(files) <= BUCKETS
    seen = {re.search(r"_(\d{5})\.", f).group(1) for f in files}
    assert len(seen) == len(files)


def test_opened_by_another_session(pair, spark):
    audit, _ = pair
    other = spark.newSession()
    path = audit.table("pagamento").inputFiles()[0]
    root = re.sub(r"^file:", "", path).rsplit("/pagamento", 1)[0]
    again = bucketed.open_audit(other, root, BUCKETS)
    assert again.table("pagamento").count() == len(CASE["pagamento"])
