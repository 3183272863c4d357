"""Each source is read once, and tasks don't grow with the input."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from driverdata import mapping
from lupafiscal import Audit, run, session
from lupafiscal.plans import store
from lupafiscal.schemas import SCHEMAS
from tests import tables

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT = "spark.sql.files.maxPartitionBytes"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def read_by_files(spark, root: str, rows: dict) -> Audit:
    source = tables.audit(spark, rows)
    for name in SCHEMAS:
        source.table(name).write.parquet(f"{root}/{name}")
    return Audit(spark, lambda name, columns: spark.read.parquet(f"{root}/{name}").select(*(columns or ["*"])))


@pytest.mark.parametrize("make", [tables.hand_made, tables.dirty_tables])
def test_key_slices_read_each_table_once(spark, tmp_path, make):
    rows = make()
    result = run("m06_key_slices", read_by_files(spark, str(tmp_path), rows))
    assert not [f for f in result.inputFiles() if str(tmp_path) in f]  # counted from the written keys
    totals = result.groupBy("tabela").sum("linhas").collect()
    assert {r[0]: r[1] for r in totals} == {name: len(rows[name]) for name in SCHEMAS}


def test_the_summary_reads_large_tables_once(spark, tmp_path):
    audit = read_by_files(spark, str(tmp_path), tables.hand_made())
    asked = []
    counting = Audit(spark, lambda name, columns: asked.append(name) or audit.reader(name, columns))
    found = run("s01_audit_summary", counting)
    for name in ("contrato", "empenho", "pagamento", "liquidacao_nota_fiscal", "nfe_pagamento"):
        assert asked.count(name) == 1
    assert tables.rows_of(found) == tables.rows_of_sql(tables.database(tables.hand_made()), "s01_audit_summary")


def test_tables_laid_out_by_commitment_stay(spark):
    audit = Audit(spark, lambda name, columns: None, colocated=True)
    assert store.with_tables_once(audit, {"empenho": ("id_empenho",)}) is audit


def test_an_opened_audit_bounds_its_tasks(spark, tmp_path, settings, monkeypatch):
    for name in mapping.BASE:
        spark.range(100).write.parquet(f"{tmp_path}/{name}.parquet")
    stored = sum(session.stored_bytes(spark, f"{tmp_path}/{name}.parquet") for name in mapping.BASE)
    settings({INITIAL: "3", SPLIT: "128m", ADVISORY: "64MB"})
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 64)
    mapping.open_audit(spark, str(tmp_path))
    assert int(spark.conf.get(INITIAL)) == math.ceil(stored / 64)
    assert int(spark.conf.get(SPLIT).rstrip("b")) == int(spark.conf.get(ADVISORY).rstrip("b")) == session.SCAN_BYTES


def test_finer_settings_stay(spark, settings):
    settings({INITIAL: "300", SPLIT: "1m", ADVISORY: "16k"})
    session.bound_tasks(spark, 1 << 30)
    assert [spark.conf.get(key) for key in (INITIAL, SPLIT, ADVISORY)] == ["300", "1m", "16k"]
    session.bound_tasks(spark, 1 << 50)  # beyond the most partitions, tasks grow
    assert spark.conf.get(INITIAL) == str(session.MOST_PARTITIONS)


def test_invoice_payments_meet_their_payments_as_grouped(spark, tmp_path, settings):
    """Texts made of order and line are not shuffled again."""
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    lines = [(1, 1, "A", 10.0), (1, 2, "A", 20.0), (1, 3, "N", 30.0), (1, 3, "N", 5.0), (50, 1, "A", 1.0), (None, 1, "A", 1.0),
             (2, None, "A", 1.0), (3, 1, None, 2.5), (4, 1, "R", 4.0)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double")
    rows.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(1, "F"), (2, "F"), (3, "F"), (4, "O"), (50, "F")], "o_orderkey long, o_orderstatus string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = mapping.Mapping(spark, str(tmp_path)).nfe_pagamento()
    assert sorted((r.id, r.chave_nfe[-2:], r.tipo_pagamento, float(r.valor_pagamento)) for r in found.collect()) == [
        ("PGT-1-2", "03", "PIX", 20.0), ("PGT-1-3", "04", "PIX", 35.0), ("PGT-3-1", "11", "CHEQUE", 2.5)]
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange hashpartitioning(l_orderkey" in text and not re.search(r"Exchange hashpartitioning\(id", text)
