"""What suppliers received, above their contracts and too early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.documents import document_status, repairs
from lupafiscal.functions.money import TOTAL, total
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts


def _early() -> Column:
    return F.count(F.when(facts.before_contract(), 1))


@check("q34_supplier_dossier")
def supplier_dossier(a: Audit) -> DataFrame:
    """Nets the payments against the distinct contract values of the supplier."""
    sums = facts.payments(a, value=False).groupBy("id_fornecedor").agg(
        F.sum("valor_pago").alias("_received"),
        F.sum_distinct("valor_contrato").alias("_ceilings"),
        _early().alias("qtd_pagamentos_antecipados"),
    )
    return (
        sums.join(facts.suppliers(a), "id_fornecedor")
        .withColumn("saldo_excedente_recebido", (F.col("_received") - F.col("_ceilings")).cast(TOTAL))
        .orderBy(F.desc("saldo_excedente_recebido"), "id_fornecedor")
        .select(
            F.col("nome_fornecedor").alias("fornecedor"),
            F.col("documento_fornecedor").alias("cnpj"),
            F.col("_received").cast(TOTAL).alias("total_recebido"),
            "saldo_excedente_recebido",
            "qtd_pagamentos_antecipados",
        )
    )


def _by_commitment(a: Audit) -> DataFrame:
    """Each commitment's payments, their sum and how many are early, and its excess over the contract."""
    sums = (
        facts.payments(a, value=False)
        .groupBy("id_empenho", "id_fornecedor", "valor_contrato")
        .agg(F.count("*").alias("n"), F.sum("valor_pago").alias("pago"), _early().alias("cedo"))
    )
    over = F.col("pago") - F.col("valor_contrato")
    return sums.withColumn("excesso", F.greatest(over, F.lit(0).cast("decimal(26,2)")))


def _risk(a: Audit, once: bool) -> DataFrame:
    """Excess of each commitment's payments over its contract, by supplier.

    The report adds a commitment's excess once per payment; ``once`` adds it
    once.  Summed per commitment, then supplier, then name and document.
    """
    weight = F.lit(1) if once else F.col("n")
    per_supplier = _by_commitment(a).groupBy("id_fornecedor").agg(
        F.sum(F.col("excesso") * weight).alias("excesso"), F.sum("cedo").alias("cedo"),
        F.sum("pago").alias("pago"))
    return (
        per_supplier.join(facts.suppliers(a), "id_fornecedor")
        .groupBy(F.col("nome_fornecedor").alias("fornecedor"),
                 F.col("documento_fornecedor").alias("cnpj"))
        .agg(total("excesso").alias("saldo_excedente_recebido"),
             F.sum("cedo").alias("qtd_pagamentos_antecipados"),
             total("pago").alias("total"))
        .orderBy(F.desc("saldo_excedente_recebido"), "cnpj", "fornecedor")
    )


@check("g04_supplier_risk_ranking")
def supplier_risk_ranking(a: Audit) -> DataFrame:
    return _risk(a, once=False).withColumnRenamed("total", "total_recebido_geral")


@check("g04b_supplier_risk_ranking_once")
def supplier_risk_ranking_once(a: Audit) -> DataFrame:
    return _risk(a, once=True).withColumnRenamed("total", "total_recebido_geral")


@check("g15_supplier_dossier")
def supplier_risk_dossier(a: Audit) -> DataFrame:
    return _risk(a, once=False).select(
        "fornecedor", "cnpj", F.col("total").alias("total_recebido"), "saldo_excedente_recebido",
        "qtd_pagamentos_antecipados")


MOST_EXPOSED = 3


@check("s02_supplier_exposure")
def supplier_exposure(a: Audit) -> DataFrame:
    """The summary's suppliers of greatest excess, the first ``MOST_EXPOSED`` by each way to reckon it.

    The ways are those of ``q34`` (by supplier), ``g04`` and ``g04b`` (by name and
    document).  All come from one pass over the payments; before the suppliers of one
    way meet in a task, each task keeps its own first ones.
    """
    sums = _by_commitment(a).groupBy("id_fornecedor").agg(
        (F.sum("pago") - F.sum_distinct("valor_contrato")).alias("liquido"),
        F.sum(F.col("excesso") * F.col("n")).alias("repetido"),
        F.sum("excesso").alias("unico"), F.sum("cedo").alias("cedo"),
    )
    ways = (
        f"stack(3, '{labels.EXPOSURE_NET}', id_fornecedor, cast(liquido as {TOTAL}), "
        f"'{labels.EXPOSURE_PER_PAYMENT}', null, cast(repetido as {TOTAL}), "
        f"'{labels.EXPOSURE_ONCE}', null, cast(unico as {TOTAL})) as (criterio, _id, saldo)"
    )
    named = sums.join(facts.suppliers(a), "id_fornecedor").selectExpr(
        ways, "nome_fornecedor as fornecedor", "documento_fornecedor as cnpj", "cedo")
    rows = named.groupBy("criterio", "_id", "fornecedor", "cnpj").agg(
        total("saldo").alias("saldo_excedente_recebido"), F.sum("cedo").alias("qtd_pagamentos_antecipados"))
    order = Window.partitionBy("criterio").orderBy(
        F.desc_nulls_last("saldo_excedente_recebido"), F.asc_nulls_first("cnpj"),
        F.asc_nulls_first("fornecedor"), F.desc("qtd_pagamentos_antecipados"))
    return (
        rows.withColumn("lugar", F.row_number().over(order)).filter(F.col("lugar") <= MOST_EXPOSED)
        .select("criterio", "lugar", "fornecedor", "cnpj", "saldo_excedente_recebido", "qtd_pagamentos_antecipados")
    )


@check("r03_supplier_document_validity")
def supplier_document_validity(a: Audit) -> DataFrame:
    """Every supplier with the first rule its document breaks, or VALIDO."""
    f = a.table("fornecedor", "id_fornecedor", "nome", "documento")
    return f.select("id_fornecedor", "nome", "documento",
                    document_status(F.col("documento")).alias("situacao_documento"))


@check("r03b_supplier_document_repair")
def supplier_document_repair(a: Audit) -> DataFrame:
    """Suppliers with an invalid document, and the valid one it stands for if there is just one."""
    f = a.table("fornecedor", "id_fornecedor", "nome", "documento")
    broken = f.withColumn("situacao_documento", document_status(F.col("documento"))).filter("situacao_documento <> 'VALIDO'")
    found = broken.withColumn("_found", F.coalesce(repairs(F.col("documento")), F.array().cast("array<string>")))
    n = F.size("_found")
    return found.select(
        "id_fornecedor", "nome", "documento", "situacao_documento",
        F.when(n == 1, F.lit(labels.DOCUMENT_REPAIRED)).when(n > 1, F.lit(labels.DOCUMENT_AMBIGUOUS))
        .otherwise(F.lit(labels.DOCUMENT_UNKNOWN)).alias("situacao_correcao"),
        F.when(n == 1, F.get("_found", F.lit(0))).alias("documento_corrigido"),
        F.array_join("_found", ",").alias("candidatos"),
    )
