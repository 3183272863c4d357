"""Order in time of contract, commitment, liquidation and payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.joins import earlier_later
from lupafiscal.functions.money import total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts
from lupafiscal.plans.facts import WITH


def _days(later: str, earlier: str) -> Column:
    return F.date_diff(later, earlier)


@check("q14_paid_before_commitment")
def paid_before_commitment(a: Audit) -> DataFrame:
    return (
        facts.payments(a, value=False, contract=None)
        .filter(facts.before_commitment())
        .select("id_empenho", "data_empenho", F.col("data_pagamento").alias("datapagamentoempenho"))
    )


@check("q15_paid_before_commitment_and_contract")
def paid_before_commitment_and_contract(a: Audit) -> DataFrame:
    early = facts.payments(a, value=False, supplier="inner").filter(
        facts.before_commitment() & facts.before_contract())
    return early.select(
        "id_empenho",
        F.col("nome_fornecedor").alias("fornecedor"),
        "data_inicio_contrato",
        "data_empenho",
        "data_pagamento",
        _days("data_inicio_contrato", "data_pagamento").alias("dias_pagou_antes_do_contrato"),
        F.col("valor_pago").alias("valor"),
    )


@check("q16_early_payment_vs_liquidation")
def early_payment_vs_liquidation(a: Audit) -> DataFrame:
    """A payment counts once per liquidation, or once if there is none."""
    e = a.table("empenho", "id_empenho", "data_empenho")
    days = facts.days_of_cycle(a).join(e, "id_empenho").filter("data_empenho > dia")
    def case(label: str, times: Column) -> Column:
        return F.struct(F.lit(label).alias("tipo_inconsistencia"), times.alias("vezes"))

    none = (F.col("n_liq_depois") + F.col("n_liq_ate") == 0).cast("long")
    cases = days.select("n_pagamentos", "total_pago", F.inline(F.array(
        case(labels.PAID_BEFORE_DELIVERY, F.col("n_liq_depois")),
        case(labels.DELIVERED_BEFORE_PAYMENT, F.col("n_liq_ate")),
        case(labels.NEVER_DELIVERED, none),
    ))).filter("vezes > 0")
    return cases.groupBy("tipo_inconsistencia").agg(
        F.sum(F.col("n_pagamentos") * F.col("vezes")).alias("qtd_casos"),
        total(F.col("total_pago") * F.col("vezes")).alias("total_envolvido"),
    )


@check("q19_liquidation_to_payment_days")
def liquidation_to_payment_days(a: Audit) -> DataFrame:
    """First liquidation and last payment do not depend on how the two are paired."""
    first = facts.liquidation_totals(a).select(
        "id_empenho", F.col("primeira_liquidacao").alias("data_liquidacao"))
    last = facts.paid_totals(a).select(
        "id_empenho", F.col("ultimo_pagamento").alias("data_pagamento"))
    return (
        a.table("empenho", "id_empenho")
        .join(first, "id_empenho")
        .join(last, "id_empenho")
        .withColumn("dias_entre_liquidacao_e_pagamento", _days("data_pagamento", "data_liquidacao"))
        .orderBy(F.desc("dias_entre_liquidacao_e_pagamento"), "id_empenho")
    )


@check("q20_finished_payment_dates")
def finished_payment_dates(a: Audit) -> DataFrame:
    """A liquidation whose invoice exists is a liquidation, so one test covers both."""
    status = (
        F.when(facts.before_contract(), F.lit(labels.FINISHED_BEFORE_TERM))
        .when(F.col("data_pagamento") == F.col("data_inicio_contrato"),
              F.lit(labels.FINISHED_ON_START))
        .otherwise(F.lit(labels.FINISHED_DURING_TERM))
    )
    return (
        facts.payments(a, value=False, invoiced=True)
        .groupBy(status.alias("status_temporal_pagamento"))
        .agg(F.count("*").alias("quantidade_pagamentos"), total("valor_pago").alias("total_pago"))
        .orderBy("status_temporal_pagamento")
    )


@check("q23_full_advances")
def full_advances(a: Audit) -> DataFrame:
    """Payments count once per later liquidation; counted by day, not paired."""
    days = facts.days_of_cycle(a).filter("n_liq_depois > 0").select(
        "id_empenho", "dia", "n_liq_depois", "n_pagamentos",
        F.col("total_pago").alias("pago_no_dia"))
    early = days.join(facts.commitments(a, value=False), "id_empenho").filter(
        "dia < data_inicio_contrato")
    return early.agg(
        F.count_distinct("id_empenho").alias("qtd_empenhos"),
        F.coalesce(F.sum(F.col("n_pagamentos") * F.col("n_liq_depois")), F.lit(0))
        .alias("qtd_pagamentos"),
        total(F.col("pago_no_dia") * F.col("n_liq_depois")).alias("total_pago"),
    )


@check("g02_early_payment_timeline")
def early_payment_timeline(a: Audit) -> DataFrame:
    return (
        facts.payments(a, value=False, body="inner", supplier="inner")
        .filter(facts.before_contract())
        .withColumn("dias_antecipacao", _days("data_inicio_contrato", "data_pagamento"))
        .orderBy(F.desc("dias_antecipacao"), "id_pagamento")
        .select(
            F.col("nome_fornecedor").alias("fornecedor"),
            F.col("nome_entidade").alias("entidade"),
            "id_contrato",
            "data_inicio_contrato",
            "data_pagamento",
            "dias_antecipacao",
            F.col("valor_pago").alias("valor_pago_indevido"),
            F.lit(labels.FINDING_EARLY).alias("gravidade_temporal"),
        )
    )


@check("g10_payment_before_commitment")
def payment_before_commitment(a: Audit) -> DataFrame:
    """Also payments of commitments without contract; their supplier is null."""
    return (
        facts.payments(a, value=False, contract="left", supplier="left")
        .filter(facts.before_commitment())
        .withColumn("dias_inconsistencia", _days("data_empenho", "data_pagamento"))
        .orderBy(F.desc("dias_inconsistencia"), "id_pagamento")
        .select("id_empenho", F.col("nome_fornecedor").alias("fornecedor"), "data_empenho",
                "data_pagamento", "dias_inconsistencia", "valor_pago")
    )


@check("g12_finished_but_early")
def finished_but_early(a: Audit) -> DataFrame:
    return (
        facts.payments(a, value=False, liquidation=WITH, supplier="inner")
        .filter(facts.before_contract())
        .orderBy("data_pagamento", "id_pagamento")
        .select("id_empenho", "id_contrato", F.col("nome_fornecedor").alias("fornecedor"),
                "data_pagamento", "data_inicio_contrato", "valor_pago",
                F.lit(labels.FINDING_FINISHED_EARLY).alias("status_auditoria"))
    )


@check("g13_irregular_advances")
def irregular_advances(a: Audit) -> DataFrame:
    """One row per early payment and later liquidation of its commitment; no other pair is made."""
    early = facts.payments(a, value=False, supplier="inner").filter(facts.before_contract()).select(
        "id_empenho", "id_pagamento", "id_contrato", "nome_fornecedor", "valor_pago",
        "data_pagamento", "data_inicio_contrato")
    delivered = facts.liquidation_rows(a).select(
        "id_empenho", "id_liq_empnf", F.col("data_emissao").alias("data_liquidacao"))
    firsts = facts.payment_rows(a).groupBy("id_empenho").agg(F.min("data_pagamento").alias("first"))
    lasts = delivered.groupBy("id_empenho").agg(F.max("data_liquidacao").alias("last"))
    pairs = earlier_later(early, delivered, "id_empenho", "data_pagamento", "data_liquidacao", firsts, lasts)
    return (
        pairs.orderBy("data_pagamento", "id_pagamento", "id_liq_empnf")
        .select("id_empenho", "id_contrato", F.col("nome_fornecedor").alias("fornecedor"),
                "valor_pago", "data_pagamento", "data_inicio_contrato", "data_liquidacao",
                F.lit(labels.FINDING_FULL_ADVANCE).alias("tipo_infracao"))
    )
