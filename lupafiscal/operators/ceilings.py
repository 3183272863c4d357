"""Payments against the value of their contract and of their commitment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.money import TOTAL, difference, total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts
from lupafiscal.plans.facts import FLAG, WITHOUT


def _paid_per_commitment(a: Audit, how: str) -> DataFrame:
    e = a.table("empenho", "id_empenho", "valor").withColumnRenamed("valor", "valor_empenhado")
    return e.join(facts.paid_totals(a), "id_empenho", how)


def _overpaid(a: Audit, excess_name: str) -> DataFrame:
    return (
        _paid_per_commitment(a, "inner")
        .filter("total_pago > valor_empenhado")
        .select("id_empenho", "valor_empenhado", F.col("total_pago").cast(TOTAL).alias("total_pago"),
                (F.col("total_pago") - F.col("valor_empenhado")).cast(TOTAL).alias(excess_name))
        .orderBy(F.desc(excess_name), "id_empenho")
    )


@check("q17_paid_over_commitment")
def paid_over_commitment(a: Audit) -> DataFrame:
    return _overpaid(a, "diferenca")


@check("g11_budget_execution")
def budget_execution(a: Audit) -> DataFrame:
    return _overpaid(a, "diferenca_estouro").withColumn(
        "status_execucao", F.lit(labels.FINDING_OVER_COMMITMENT))


@check("q18_commitment_payment_status")
def commitment_payment_status(a: Audit) -> DataFrame:
    paid, held = F.coalesce("total_pago", F.lit(0)), F.col("valor_empenhado")
    status = (
        F.when(paid > held, F.lit(labels.OVERPAID))
        .when(paid == held, F.lit(labels.PAID_EXACTLY))
        .otherwise(F.lit(labels.NOT_PAID_IN_FULL))
    )
    return (
        _paid_per_commitment(a, "left")
        .groupBy(status.alias("status_pagamento"))
        .agg(F.count("*").alias("quantidade_empenhos"))
        .orderBy("status_pagamento")
    )


def _by_class(paid: DataFrame, name: str, value: Column) -> DataFrame:
    return (
        paid.groupBy(value.alias(name))
        .agg(F.count("*").alias("quantidade_pagamentos"), total("valor_pago").alias("total_pago"))
        .orderBy(name)
    )


@check("q24_payment_over_ceiling_summary", "g06_over_ceiling_summary")
def payment_over_ceiling_summary(a: Audit) -> DataFrame:
    status = (
        F.when(facts.over_contract(), F.lit(labels.OVER_CONTRACT))
        .when(F.col("valor_pago") > F.col("valor_empenhado"), F.lit(labels.OVER_COMMITMENT))
        .otherwise(F.lit(labels.WITHIN_LIMIT))
    )
    return _by_class(facts.payments(a), "status_pagamento", status)


@check("q25_over_contract_by_validity")
def over_contract_by_validity(a: Audit) -> DataFrame:
    status = (
        F.when(facts.before_contract(), F.lit(labels.BEFORE_TERM))
        .when(F.col("data_pagamento") == F.col("data_inicio_contrato"),
              F.lit(labels.ON_START))
        .otherwise(F.lit(labels.DURING_TERM))
    )
    over = facts.payments(a, value=False).filter(facts.over_contract())
    return _by_class(over, "status_vigencia_pagamento", status)


@check("q26_over_contract_by_liquidation")
def over_contract_by_liquidation(a: Audit) -> DataFrame:
    status = F.when(F.col("tem_liquidacao"), F.lit(labels.LIQUIDATED)).otherwise(
        F.lit(labels.NOT_LIQUIDATED))
    over = facts.payments(a, value=False, liquidation=FLAG).filter(facts.over_contract())
    return _by_class(over, "status_liquidacao", status)


@check("c13_over_contract_detail")
def over_contract_detail(a: Audit) -> DataFrame:
    moment = F.when(facts.before_contract(), F.lit(labels.LIST_BEFORE_TERM)).otherwise(
        F.lit(labels.LIST_DURING_TERM))
    return (
        facts.payments(a, value=False, supplier="inner")
        .filter(facts.over_contract())
        .select("id_pagamento", F.col("nome_fornecedor").alias("fornecedor"), "id_contrato",
                "valor_contrato", "valor_pago",
                difference("valor_pago", "valor_contrato").alias("valor_excedente"),
                moment.alias("momento_pagamento"))
        .orderBy(F.desc("valor_excedente"), "id_pagamento")
    )


def _critical(a: Audit) -> DataFrame:
    """Distinct before the names come in: they follow from the commitment."""
    over = facts.payments(a, liquidation=WITHOUT).filter(facts.over_contract())
    return (
        over.select("id_empenho", "valor_empenhado", "valor_contrato", "valor_pago",
                    "id_fornecedor", "id_entidade")
        .distinct()
        .join(facts.bodies(a), "id_entidade")
        .join(facts.suppliers(a), "id_fornecedor")
        .withColumn("valor_excedente", difference("valor_pago", "valor_contrato"))
        .withColumnRenamed("nome_entidade", "orgao_pagador")
    )


@check("q29_critical_cases", "g07_critical_cases")
def critical_cases(a: Audit) -> DataFrame:
    return _critical(a).orderBy("id_empenho", "valor_pago").select(
        "id_empenho", "valor_empenhado", "valor_contrato", "valor_pago", "valor_excedente",
        "nome_fornecedor", "orgao_pagador")


@check("c15_critical_detail")
def critical_detail(a: Audit) -> DataFrame:
    return _critical(a).orderBy(F.desc("valor_excedente"), "id_empenho", "valor_pago").select(
        "orgao_pagador", "nome_fornecedor", "id_empenho", "valor_contrato", "valor_pago",
        "valor_excedente", F.lit(labels.FINDING_CRITICAL).alias("status_auditoria"))
