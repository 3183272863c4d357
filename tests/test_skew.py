"""A third of the payments or liquidations on one commitment."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lupafiscal import Audit, run
from tests import tables

# thresholds lowered so that a test-sized key counts as hot; Spark goes by compressed bytes,
# and equal keys compress well
SMALL_UNITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "12",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "12",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
}
ROWS = 60_000


def skewed(spark, hot_liquidations: int = 0, hot_contract: bool = False, hot_invoice: bool = False) -> Audit:
    """Commitment E0 has a third of all payments and ``hot_liquidations`` liquidations.

    ``hot_contract``: contract 0 has a third of all commitments; ``hot_invoice``: a third of
    all liquidations name one invoice.  Five suppliers and three bodies share everything.
    """
    n = F.col("id")
    base = tables.audit(spark, tables.hand_made())
    others = 20_000
    money = lambda c: c.cast("decimal(15,2)")
    day = lambda c: F.date_add(F.lit(tables.DAY0), c.cast("int"))
    key = lambda c: F.concat(F.lit("E"), c.cast("string"))
    commitments = spark.range(others).select(
        key(n).alias("id_empenho"), F.lit(2024).alias("ano"), day(n % 30).alias("data_empenho"),
        F.lit("1").alias("cpfcnpjcredor"), F.lit("A").alias("credor"),
        money(n % 500 + 100).alias("valor"), F.lit(1).cast("long").alias("id_entidade"),
        (F.when(n % 3 == 0, 0).otherwise(n) if hot_contract else n).cast("long").alias("id_contrato"))
    contracts = spark.range(others).select(
        n.alias("id_contrato"), money(n % 400 + 90).alias("valor"), day(n % 40).alias("data"),
        F.lit("Obras").alias("objeto"), (n % 3 + 1).alias("id_entidade"),
        (n % 5 + 10).alias("id_fornecedor"))
    owner = F.when(n % 3 == 0, 0).otherwise(n % others)
    payments = spark.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("P"), F.md5(n.cast("string"))).alias("id_pagamento"), key(owner).alias("id_empenho"),
        day(F.pmod(F.xxhash64(n), F.lit(400))).alias("datapagamentoemp"),
        money(F.xxhash64(n) % 600 / 2 + 300).alias("valor"))
    liquidations = spark.range(0, 10_000, 1, 8).select(
        n.alias("id_liq_empnf"),
        F.concat(F.lit("N"), F.when((n % 3 == 0) & F.lit(hot_invoice), 0).otherwise(n).cast("string"))
        .alias("chave_danfe"),
        day(n % 45).alias("data_emissao"), money(n % 90 + 1).alias("valor"),
        key(F.when(n < hot_liquidations, 0).otherwise(n * 2 + 1)).alias("id_empenho"))
    invoices = spark.range(0, 10_000, 1, 8).select(
        n.alias("id"), F.concat(F.lit("N"), n.cast("string")).alias("chave_nfe"),
        n.cast("string").alias("numero_nfe"), F.lit(None).cast("timestamp_ntz").alias("data_hora_emissao"),
        F.lit("11222333000181").alias("cnpj_emitente"), money(n % 90 + 1).alias("valor_total_nfe"))
    changed = {"nfe": invoices, "empenho": commitments, "contrato": contracts, "pagamento": payments,
               "liquidacao_nota_fiscal": liquidations}
    return Audit(spark, lambda name, columns: (
        changed[name].select(*columns) if name in changed else base.table(name, *columns)))


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "q24_payment_over_ceiling_summary",
    "q04_payments_without_liquidation",
    "q14_paid_before_commitment",
    "g04_supplier_risk_ranking",
    "g09_open_contract_dates",
    "q33_entity_impact",
    "m04_expense_by_object",
])
def test_hot_commitment_is_split(spark, settings, name):
    settings(SMALL_UNITS)
    df = run(name, skewed(spark))
    assert re.search(r"SortMergeJoin\(skew=true\) \[id_empenho", final_plan(df))


@pytest.mark.parametrize("name", ["q07_fiscal_integrity", "g13_irregular_advances",
                                  "m01_irregularity_report"])
def test_pairs_of_a_hot_commitment_are_split(spark, settings, name):
    settings(SMALL_UNITS)
    df = run(name, skewed(spark, hot_liquidations=3))
    assert re.search(r"SortMergeJoin\(skew=true\) \[id_empenho", final_plan(df))


def test_hot_contract_is_split(spark, settings):
    settings(SMALL_UNITS)
    df = run("q24_payment_over_ceiling_summary", skewed(spark, hot_contract=True))
    assert re.search(r"SortMergeJoin\(skew=true\) \[id_contrato", final_plan(df))


def test_hot_invoice_is_split(spark, settings):
    settings(SMALL_UNITS)
    df = run("q22_finished_without_payment", skewed(spark, hot_invoice=True))
    assert re.search(r"SortMergeJoin\(skew=true\) \[chave_danfe", final_plan(df))


@pytest.mark.parametrize("key", ["id_fornecedor", "id_entidade"])
def test_hot_supplier_and_body_are_split(spark, settings, key):
    settings(SMALL_UNITS)
    df = run("g02_early_payment_timeline", skewed(spark))
    assert re.search(rf"SortMergeJoin\(skew=true\) \[{key}", final_plan(df))


def test_names_come_after_the_sums(spark, settings):
    """A supplier with most payments reaches the join with names as one row."""
    settings(SMALL_UNITS)
    text = final_plan(run("q34_supplier_dossier", skewed(spark)))
    assert not re.search(r"SortMergeJoin\(skew=true\) \[id_fornecedor", text)


def test_skew_changes_no_result(spark, settings):
    settings(SMALL_UNITS)
    a = skewed(spark, hot_liquidations=2_000, hot_contract=True, hot_invoice=True)
    split = run("q23_full_advances", a).first(), run("q33_entity_impact", a).collect()
    settings({"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10MB"})
    assert split == (run("q23_full_advances", a).first(), run("q33_entity_impact", a).collect())
    paired = spark_pairs(a)
    assert tuple(split[0]) == paired


def spark_pairs(a: Audit) -> tuple:
    """The full advances by making every pair."""
    from lupafiscal.plans import facts

    pairs = facts.payments(a).join(facts.liquidation_rows(a), "id_empenho").filter(
        "data_pagamento < data_inicio_contrato and data_pagamento < data_emissao")
    return tuple(pairs.agg(F.count_distinct("id_empenho"), F.count("*"),
                           F.sum("valor_pago").cast("decimal(38,2)")).first())


def test_counting_by_day_keeps_hot_groups_small(spark):
    """The window sees days, not payments, and gives the paired result."""
    from lupafiscal.plans import facts

    a = skewed(spark, hot_liquidations=2_000)
    days = facts.days_of_cycle(a)
    assert days.groupBy("id_empenho").count().agg(F.max("count")).first()[0] <= 400
    by_count = days.agg(F.sum(F.col("n_pagamentos") * F.col("n_liq_depois"))).first()[0]
    pairs = facts.payment_rows(a).join(facts.liquidation_rows(a), "id_empenho")
    assert by_count == pairs.filter("data_emissao > data_pagamento").count()
