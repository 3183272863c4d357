"""Electronic invoices and invoice payments against liquidations and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.documents import canonical
from lupafiscal.functions.joins import distinct_keys, having, lacking, spread_join
from lupafiscal.functions.money import TOTAL, difference, total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts


def _both_sides(a: Audit) -> DataFrame:
    """One row per commitment that is both paid and liquidated."""
    paid = facts.paid_totals(a)
    return paid.join(facts.liquidation_totals(a), "id_empenho")


def _excess_over_invoices(rows: DataFrame) -> DataFrame:
    return (
        rows.filter("pago > liquidado")
        .select("id_empenho", F.col("nome_fornecedor").alias("fornecedor"),
                F.col("liquidado").cast(TOTAL).alias("total_nota_fiscal"),
                F.col("pago").cast(TOTAL).alias("total_pago_banco"),
                (F.col("pago") - F.col("liquidado")).cast(TOTAL).alias("diferenca_indevida"))
        .orderBy(F.desc("diferenca_indevida"), "id_empenho")
    )


@check("q30_paid_over_invoices")
def paid_over_invoices(a: Audit) -> DataFrame:
    """As the report defines it: the supplier is looked up by the contract number, and
    each sum counts once per row of the other side."""
    sums = (
        _both_sides(a)
        .withColumn("pago", F.col("total_pago") * F.col("n_liquidacoes"))
        .withColumn("liquidado", F.col("total_liquidado") * F.col("n_pagamentos"))
        .filter("pago > liquidado")
    )
    e = a.table("empenho", "id_empenho", "id_contrato").select(
        "id_empenho", F.col("id_contrato").alias("id_fornecedor"))
    return _excess_over_invoices(
        sums.join(e, "id_empenho").join(facts.suppliers(a), "id_fornecedor"))


@check("q30b_paid_over_invoices_corrected")
def paid_over_invoices_corrected(a: Audit) -> DataFrame:
    """The supplier comes from the contract and each side is summed once."""
    sums = (
        _both_sides(a)
        .withColumnsRenamed({"total_pago": "pago", "total_liquidado": "liquidado"})
        .filter("pago > liquidado")
    )
    return _excess_over_invoices(
        facts.commitments(a, value=False).join(sums, "id_empenho")
        .join(facts.suppliers(a), "id_fornecedor"))


def _differing(a: Audit) -> DataFrame:
    """Invoices of known commitments whose amount isn't the liquidated one."""
    n = a.table("nfe", "chave_nfe", "numero_nfe", "cnpj_emitente", "valor_total_nfe")
    booked = facts.liquidation_rows(a).select(
        F.col("chave_danfe").alias("chave_nfe"), "id_empenho", "id_liq_empnf", "valor_liquidado")
    differing = booked.join(n, "chave_nfe").filter("valor_total_nfe <> valor_liquidado")
    return having(differing, a.table("empenho", "id_empenho"), "id_empenho")


def _divergence(rows: DataFrame, *more: str) -> DataFrame:
    return (
        rows.withColumn("divergencia_fiscal", difference("valor_total_nfe", "valor_liquidado"))
        .orderBy(F.desc(F.abs("divergencia_fiscal")), "id_liq_empnf")
        .select(F.col("nome").alias("fornecedor"), "numero_nfe",
                F.col("valor_total_nfe").alias("valor_real_da_nota"),
                F.col("valor_liquidado").alias("valor_lancado_no_sistema"),
                "divergencia_fiscal", "id_empenho", *more)
    )


@check("q31_invoice_divergence")
def invoice_divergence(a: Audit) -> DataFrame:
    issuers = a.table("fornecedor", "nome", "documento").withColumnRenamed(
        "documento", "cnpj_emitente")
    return _divergence(_differing(a).join(issuers, "cnpj_emitente"))


@check("q31b_invoice_divergence_canonical")
def invoice_divergence_canonical(a: Audit) -> DataFrame:
    """Issuer and supplier meet by the valid document that each one's stands for, or as written
    if it stands for none; an invoice of no known supplier is listed without one."""
    def meant(column: str):
        return F.coalesce(canonical(F.col(column)), F.col(column))

    issuers = a.table("fornecedor", "nome", "documento").select("nome", meant("documento").alias("documento_emitente"))
    rows = _differing(a).withColumn("documento_emitente", meant("cnpj_emitente"))
    return _divergence(spread_join(rows, issuers, "documento_emitente", "left"), "documento_emitente")


@check("q32_modus_operandi", "g14_modus_operandi")
def modus_operandi(a: Audit) -> DataFrame:
    """Matched on the amount; equal amounts are counted first, so that an amount that
    many invoice payments share is one row per payment type."""
    counted = (
        a.table("nfe_pagamento", "tipo_pagamento", "valor_pagamento")
        .groupBy("tipo_pagamento", F.col("valor_pagamento").alias("valor_pago"))
        .agg(F.count("*").alias("n"))
    )
    over = facts.payments(a, value=False).filter(facts.over_contract())
    return (
        having(counted, distinct_keys(over, "valor_pago"), "valor_pago")
        .groupBy("tipo_pagamento")
        .agg(F.sum("n").alias("frequencia"),
             total(F.col("valor_pago") * F.col("n")).alias("volume_financeiro_suspeito"))
        .orderBy(F.desc("volume_financeiro_suspeito"), "tipo_pagamento")
    )


def _orphans(a: Audit) -> DataFrame:
    booked = distinct_keys(a.table("liquidacao_nota_fiscal", "chave_danfe"), "chave_danfe",
                           "chave_nfe")
    links = a.table("nfe_pagamento", "chave_nfe", "tipo_pagamento", "valor_pagamento")
    return lacking(links, booked, "chave_nfe").select(
        "chave_nfe", "tipo_pagamento", F.col("valor_pagamento").alias("valor_nfe_pagamento"),
        F.lit(labels.FINDING_ORPHAN).alias("status_auditoria"))


@check("q35_orphan_invoice_payments")
def orphan_invoice_payments(a: Audit) -> DataFrame:
    return _orphans(a)


@check("g16_orphan_table")
def orphan_table(a: Audit) -> DataFrame:
    return _orphans(a).orderBy(F.desc("valor_nfe_pagamento"), "chave_nfe")
