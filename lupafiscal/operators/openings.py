"""Payments and contracts still open: paid without a recorded delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.joins import having, spread_join
from lupafiscal.functions.money import TOTAL, difference, total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts
from lupafiscal.plans.facts import WITHOUT


def _unliquidated(a: Audit) -> DataFrame:
    return facts.payments(a, value=False, contract=None, liquidation=WITHOUT)


def _invoice_status() -> Column:
    return F.when(F.col("tem_nfe_pagamento"), F.lit(labels.WITH_INVOICE)).otherwise(
        F.lit(labels.WITHOUT_INVOICE))


@check("q04_payments_without_liquidation", "g05_payments_without_liquidation")
def payments_without_liquidation(a: Audit) -> DataFrame:
    return _unliquidated(a).select("id_empenho", "id_pagamento", "valor_pago").distinct()


@check("q05_invoice_status_of_unliquidated")
def invoice_status_of_unliquidated(a: Audit) -> DataFrame:
    flagged = facts.with_invoice_flags(a, _unliquidated(a))
    return flagged.groupBy(_invoice_status().alias("status_fiscal")).agg(
        F.count_distinct("id_pagamento").alias("qtd_pagamentos"))


@check("c02_unliquidated_detail")
def unliquidated_detail(a: Audit) -> DataFrame:
    flagged = facts.with_invoice_flags(a, _unliquidated(a))
    return flagged.select("id_empenho", "id_pagamento", "valor_pago", "data_pagamento",
                          _invoice_status().alias("status_fiscal_pagamento")).distinct()


@check("q07_fiscal_integrity")
def fiscal_integrity(a: Audit) -> DataFrame:
    """Every payment with every liquidation of its commitment, as the report lists them."""
    paid = facts.with_invoice_flags(
        a, facts.payment_rows(a).select("id_empenho", "id_pagamento", "valor_pago"))
    known = a.table("empenho", "id_empenho")
    delivered = having(facts.liquidation_rows(a), known, "id_empenho").select(
        "id_empenho",
        F.col("id_liq_empnf").alias("registro_liquidacao"),
        F.col("chave_danfe").alias("chave_nfe_liquidacao"),
    )
    status = F.when(F.col("tem_nfe_pagamento"), F.lit(labels.INTEGRITY_COMPLETE)).otherwise(
        F.lit(labels.INTEGRITY_PENDING))
    return (
        spread_join(paid, delivered, "id_empenho")
        .select("id_empenho", "id_pagamento", "valor_pago", "registro_liquidacao",
                "chave_nfe_liquidacao", status.alias("status_integridade_fiscal"))
        .orderBy("id_empenho", "id_pagamento", "registro_liquidacao")
    )


def _open_commitments(a: Audit) -> DataFrame:
    """One row per commitment with open payments; the other columns follow from its key."""
    return facts.open_payments(a).groupBy(
        "id_empenho", "id_contrato", "id_fornecedor", "valor_empenhado", "valor_contrato"
    ).agg(F.count("*").alias("n_pagamentos"), F.sum("valor_pago").alias("total_pago"))


@check("q08_open_paid_totals")
def open_paid_totals(a: Audit) -> DataFrame:
    return (
        _open_commitments(a)
        .join(facts.suppliers(a), "id_fornecedor")
        .select("id_contrato", "id_empenho", F.col("nome_fornecedor").alias("fornecedor"),
                F.col("total_pago").cast(TOTAL).alias("total_pago_em_aberto"))
    )


@check("q11_commitment_vs_contract")
def commitment_vs_contract(a: Audit) -> DataFrame:
    """Values count once per open payment, as in the report; multiplied, not repeated."""
    held, ceiling = F.col("valor_empenhado"), F.col("valor_contrato")
    relation = (
        F.when(held > ceiling, F.lit(labels.COMMITMENT_ABOVE))
        .when(held < ceiling, F.lit(labels.COMMITMENT_BELOW))
        .otherwise(F.lit(labels.COMMITMENT_EQUAL))
    )
    return _open_commitments(a).groupBy(relation.alias("relacao_empenho_contrato")).agg(
        F.count_distinct("id_empenho").alias("quantidade_empenhos"),
        total(held * F.col("n_pagamentos")).alias("total_reservado"),
        total(ceiling * F.col("n_pagamentos")).alias("total_contratado"),
    )


@check("q12_real_excess_paid", "g01_detailed_irregularities")
def real_excess_paid(a: Audit) -> DataFrame:
    return (
        _open_commitments(a)
        .filter("valor_empenhado > valor_contrato")
        .join(facts.suppliers(a), "id_fornecedor")
        .select(
            "id_empenho",
            F.col("nome_fornecedor").alias("fornecedor"),
            "valor_contrato",
            "valor_empenhado",
            difference("valor_empenhado", "valor_contrato").alias("excesso_no_empenho"),
            F.col("total_pago").cast(TOTAL).alias("total_ja_pago"),
            (F.col("total_pago") - F.col("valor_contrato")).cast(TOTAL).alias("excesso_pago_real"),
        )
        .orderBy(F.desc("excesso_pago_real"), "id_empenho")
    )


@check("q13_open_payment_dates")
def open_payment_dates(a: Audit) -> DataFrame:
    moment = F.when(facts.before_contract(), F.lit(labels.OPEN_BEFORE_CONTRACT)).when(
        F.col("data_pagamento") >= F.col("data_inicio_contrato"), F.lit(labels.OPEN_DURING_TERM))
    return facts.open_payments(a, value=False).groupBy(moment.alias("checagem_data")).agg(
        F.count("*").alias("qtd_pagamentos"))


@check("g08_open_overvalued_contracts")
def open_overvalued_contracts(a: Audit) -> DataFrame:
    """Invoice payments play no part here, unlike in the excess list above."""
    sums = facts.paid_totals(a)
    return (
        facts.commitments(a, liquidation=WITHOUT)
        .filter("valor_empenhado > valor_contrato")
        .join(sums, "id_empenho")
        .join(facts.suppliers(a), "id_fornecedor")
        .select(
            "id_contrato",
            "id_empenho",
            F.col("nome_fornecedor").alias("fornecedor"),
            "valor_contrato",
            F.col("valor_empenhado").alias("valor_reservado_empenho"),
            difference("valor_empenhado", "valor_contrato").alias("excesso_reservado"),
            F.col("total_pago").cast(TOTAL).alias("total_ja_pago"),
            F.lit(labels.FINDING_OPEN_OVERVALUED).alias("risco_detectado"),
        )
        .orderBy(F.desc("excesso_reservado"), "id_empenho")
    )


@check("g09_open_contract_dates")
def open_contract_dates(a: Audit) -> DataFrame:
    moment = F.when(facts.before_contract(), F.lit(labels.OPEN_BEFORE_CONTRACT)).otherwise(
        F.lit(labels.OPEN_DURING_TERM))
    return (
        facts.payments(a, value=False, liquidation=WITHOUT)
        .select("id_empenho", "id_pagamento", F.col("data_pagamento").alias("datapagamentoempenho"),
                "data_inicio_contrato", moment.alias("checagem_data"), "valor_pago")
        .orderBy("datapagamentoempenho", "id_pagamento")
    )
