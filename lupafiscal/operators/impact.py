"""Money at risk, by commitment and by public body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.money import TOTAL, total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts
from lupafiscal.plans.facts import COUNT, FLAG


def _consolidated(a: Audit, once: bool) -> DataFrame:
    """A commitment's payments count once per liquidation, or ``once`` at all."""
    sums = facts.paid_totals(a)
    times = F.lit(1) if once else F.greatest(F.col("n_liquidacoes"), F.lit(1))
    over = F.col("pago") > F.col("valor_contrato")
    none = F.col("n_liquidacoes") == 0
    return (
        facts.commitments(a, value=False, liquidation=COUNT)
        .join(sums, "id_empenho")
        .withColumn("pago", F.col("total_pago") * times)
        .filter(over | none)
        .join(facts.bodies(a), "id_entidade")
        .select(
            "id_empenho",
            F.col("nome_entidade").alias("entidade_responsavel"),
            F.when(over, F.lit(labels.RISK_OVERPRICE))
            .when(none, F.lit(labels.RISK_NO_DELIVERY))
            .otherwise(F.lit(labels.RISK_OTHER))
            .alias("categoria_risco"),
            F.when(over, F.col("pago") - F.col("valor_contrato"))
            .otherwise(F.col("pago"))
            .cast(TOTAL)
            .alias("valor_risco_financeiro"),
        )
        .orderBy(F.desc("valor_risco_financeiro"), "id_empenho")
    )


@check("g03_consolidated_impact")
def consolidated_impact(a: Audit) -> DataFrame:
    return _consolidated(a, once=False)


@check("g03b_consolidated_impact_once")
def consolidated_impact_once(a: Audit) -> DataFrame:
    return _consolidated(a, once=True)


@check("q33_entity_impact")
def entity_impact(a: Audit) -> DataFrame:
    """Summed per body before its name comes in; a commitment has one body."""
    over = facts.over_contract()
    risk = F.when(over, F.col("valor_pago") - F.col("valor_contrato")).otherwise(F.col("valor_pago"))
    per_body = (
        facts.payments(a, value=False, liquidation=FLAG)
        .filter(over | ~F.col("tem_liquidacao"))
        .groupBy("id_entidade")
        .agg(F.count_distinct("id_empenho").alias("n"), F.sum(risk).alias("risco"))
    )
    return (
        per_body.join(facts.bodies(a), "id_entidade")
        .groupBy(F.col("nome_entidade").alias("entidade_responsavel"))
        .agg(F.sum("n").alias("qtd_empenhos_problematicos"),
             total("risco").alias("total_risco_financeiro"))
        .orderBy(F.desc("total_risco_financeiro"), "entidade_responsavel")
    )


@check("r02_total_spent_by_entity")
def total_spent_by_entity(a: Audit) -> DataFrame:
    spent = facts.payments(a, value=False).groupBy("id_entidade").agg(
        F.count("*").alias("qtd_pagamentos"), F.sum("valor_pago").alias("pago"))
    return (
        spent.join(facts.bodies(a), "id_entidade")
        .withColumn("total_gasto", F.col("pago").cast(TOTAL))
        .orderBy(F.desc("total_gasto"), "id_entidade")
        .select("id_entidade", "nome_entidade", "qtd_pagamentos", "total_gasto")
    )
