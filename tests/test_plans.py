"""What Spark will do with the checks on large tables."""

from __future__ import annotations

import re

import pytest

from lupafiscal import CHECKS, run
from lupafiscal.sources import parquet
from tests import tables

# every input is treated as too large to broadcast
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("audit") / "tables")
    parquet.write_tables(tables.audit(spark, tables.hand_made()), root)
    return parquet.open_audit(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in CHECKS if n not in ("m02_csv_sink", "m03_csv_source")))
def test_no_check_pairs_all_rows_or_leaves_the_jvm(audit, settings, name):
    settings(LARGE)
    text = plan(run(name, audit))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|ArrowEval|MapInPandas|Scan ExistingRDD", text)
    assert "SinglePartition" not in text or _ends_in_one_row(text)


def _ends_in_one_row(text: str) -> bool:
    """One partition only ever receives partial aggregates without a key."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line and "partial_" not in lines[i + 1]:
            return False
    return True


def test_columns_and_filters_reach_the_scan(audit, settings):
    settings(LARGE)
    text = plan(run("q24_payment_over_ceiling_summary", audit))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {
        "struct<id_contrato:bigint,valor:decimal(15,2)>",
        "struct<id_empenho:string,valor:decimal(15,2)>",
        "struct<id_empenho:string,valor:decimal(15,2),id_contrato:bigint>",
    }
    assert "PushedFilters: [IsNotNull(id_empenho)]" in text


def test_not_exists_is_an_anti_join(audit, settings):
    settings(LARGE)
    text = plan(run("g09_open_contract_dates", audit))
    assert "LeftAnti" in text and "LeftOuter" not in text


def test_payments_are_shuffled_once_for_a_summary(audit, settings):
    settings(LARGE)
    text = plan(run("q24_payment_over_ceiling_summary", audit))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    # commitments and contracts by contract, both sides by commitment, then three classes
    assert len(exchanges) == 5


def test_small_sides_are_broadcast_by_their_size_not_by_hint(audit):
    assert "BroadcastHashJoin" in plan(run("g02_early_payment_timeline", audit))


def test_report_counts_liquidations_and_moves_payments_once(audit, settings):
    settings(LARGE)
    df = run("m01_irregularity_report", audit)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert "Union" not in text
    assert text.count("Scan parquet") == 6  # each table once; nfe and nfe_pagamento are not needed
    assert "ReusedExchange" not in text


NAMED = ["m01", "c13", "g02", "g10", "g12", "g13", "q15"]


@pytest.mark.parametrize("key", NAMED)
def test_names_are_joined_to_contracts(audit, settings, key):
    """Payments are moved for the join with their commitments and for the order, not for names."""
    settings(LARGE)
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    text = plan(run(name, audit))
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "id_fornecedor" in line]
    assert rows
    tree = text.splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(tree)}
    payments = next(i for i, line in enumerate(tree) if "FileScan" in line and "datapagamentoemp" in line or "/pagamento" in line)
    # No exchange by supplier or body lies on the way from the payments' scan up to the result.
    level = depth[payments]
    for i in range(payments - 1, -1, -1):
        if depth[i] < level:
            level = depth[i]
            assert not re.search(r"Exchange hashpartitioning\(id_(fornecedor|entidade)", tree[i])
