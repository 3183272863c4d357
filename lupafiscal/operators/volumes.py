"""How many there are: commitments, contracts, suppliers, bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal import labels
from lupafiscal.audit import Audit
from lupafiscal.functions.joins import distinct_keys, having, lacking
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


@check("q01_total_commitments")
def total_commitments(a: Audit) -> DataFrame:
    return _count(a.table("empenho", "id_empenho"), "total_empenhos")


@check("q02_commitments_with_payment")
def commitments_with_payment(a: Audit) -> DataFrame:
    """Also commitments that the registry does not have."""
    return _count(facts.paid_keys(a), "total_empenhos_com_pagamento")


@check("q03_full_cycle_commitments")
def full_cycle_commitments(a: Audit) -> DataFrame:
    e = a.table("empenho", "id_empenho")
    e = having(having(e, facts.paid_keys(a), "id_empenho"), facts.liquidated_keys(a), "id_empenho")
    return e.agg(F.count_distinct("id_empenho").alias("total_empenhos_regulares"))


@check("q06_total_contracts")
def total_contracts(a: Audit) -> DataFrame:
    return _count(a.table("contrato", "id_contrato"), "total_contratos")


def _uncommitted(a: Audit) -> DataFrame:
    committed = distinct_keys(a.table("empenho", "id_contrato"), "id_contrato")
    return lacking(facts.contracts(a), committed, "id_contrato")


@check("q09_contracts_without_commitment")
def contracts_without_commitment(a: Audit) -> DataFrame:
    return _uncommitted(a).select(
        "id_contrato",
        "valor_contrato",
        F.lit(None).cast("string").alias("id_empenho"),
        F.lit(labels.NO_COMMITMENT).alias("status_contrato_empenho"),
    )


@check("q10_contracts_without_commitment_registry")
def contracts_without_commitment_registry(a: Audit) -> DataFrame:
    return (
        _uncommitted(a)
        .join(facts.bodies(a), "id_entidade")
        .join(facts.suppliers(a), "id_fornecedor")
        .select("id_contrato", "objeto", "nome_entidade", "nome_fornecedor")
    )


@check("q21_commitments_without_payment")
def commitments_without_payment(a: Audit) -> DataFrame:
    unpaid = lacking(a.table("empenho", "id_empenho"), facts.paid_keys(a), "id_empenho")
    return _count(unpaid, "empenhos_sem_pagamento")


@check("q22_finished_without_payment")
def finished_without_payment(a: Audit) -> DataFrame:
    e = having(a.table("empenho", "id_empenho"), facts.invoiced_keys(a), "id_empenho")
    return _count(lacking(e, facts.paid_keys(a), "id_empenho"), "finalizados_sem_pagamento")


@check("q27_total_suppliers")
def total_suppliers(a: Audit) -> DataFrame:
    return _count(a.table("fornecedor", "id_fornecedor"), "total_fornecedores")


@check("q28_contracts_per_supplier")
def contracts_per_supplier(a: Audit) -> DataFrame:
    # counted per supplier first, so a supplier with most contracts joins as one row
    held = a.table("contrato", "id_contrato", "id_fornecedor").groupBy("id_fornecedor").agg(
        F.count("id_contrato").alias("_held"))
    return (
        facts.suppliers(a)
        .join(held, "id_fornecedor", "left")
        .select("id_fornecedor", "nome_fornecedor",
                F.coalesce("_held", F.lit(0)).alias("quantidade_contratos"))
        .orderBy(F.desc("quantidade_contratos"), "id_fornecedor")
    )


@check("r01_entity_count")
def entity_count(a: Audit) -> DataFrame:
    return _count(a.table("entidade", "id_entidade"), "total_entidades")
