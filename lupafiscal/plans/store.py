"""Write the payment and commitment facts once, for an audit that runs many checks.

The fact joins payments, commitments, contracts and the existence flags.  Once
written as Parquet, the payment checks read their columns from it and need no
join but the one for names.  The commitment fact has the sums of payments and
liquidations per commitment, so that checks at that grain scan neither.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal import session
from lupafiscal.audit import Audit
from lupafiscal.plans import facts


def payment_fact(a: Audit) -> DataFrame:
    """One row per payment of a known commitment."""
    side = facts.commitments(a, contract=None, liquidation=facts.COUNT)
    invoiced = facts.invoiced_keys(a).withColumn("_invoiced", F.lit(True))
    side = side.join(invoiced, "id_empenho", "left").select(
        *side.columns,
        (F.col("n_liquidacoes") > 0).alias("tem_liquidacao"),
        F.col("_invoiced").isNotNull().alias("tem_nfe"),
    )
    known = facts.contracts(a).withColumn("_known", F.lit(True))
    side = side.join(known, "id_contrato", "left")
    side = side.withColumn("contrato_existe", F.col("_known").isNotNull()).drop("_known")
    fact = facts.by_commitment(a, facts.payment_rows(a), side)
    return facts.with_invoice_flags(a, fact)


def write_payment_fact(a: Audit, path: str) -> None:
    payment_fact(a).write.mode("errorifexists").parquet(path)


def with_stored_fact(a: Audit, path: str) -> Audit:
    return a.with_payment_fact(a.spark.read.parquet(path))


def commitment_fact(a: Audit) -> DataFrame:
    """One row per commitment that is known, paid or liquidated."""
    known = facts.commitments(a, contract=None).withColumn("conhecido", F.lit(True))
    paid, delivered = facts.paid_totals(a), facts.liquidation_totals(a)
    invoiced = facts.invoiced_keys(a).withColumn("tem_nfe", F.lit(True))
    rows = known.join(paid, "id_empenho", "full").join(delivered, "id_empenho", "full").join(invoiced, "id_empenho", "full")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return rows.filter(F.col("id_empenho").isNotNull()).select(
        "id_empenho", F.coalesce("conhecido", no).alias("conhecido"), "data_empenho", "id_contrato", "valor_empenhado",
        F.coalesce("n_pagamentos", zero).alias("n_pagamentos"), "total_pago", "ultimo_pagamento",
        F.coalesce("n_liquidacoes", zero).alias("n_liquidacoes"), "total_liquidado", "primeira_liquidacao",
        F.coalesce("tem_nfe", no).alias("tem_nfe"),
    )


def write_commitment_fact(a: Audit, path: str) -> None:
    commitment_fact(a).write.mode("errorifexists").parquet(path)


def with_stored_commitments(a: Audit, path: str) -> Audit:
    return a.with_commitment_fact(a.spark.read.parquet(path))


def write_facts(a: Audit, root: str) -> None:
    """Both facts, below one root."""
    write_payment_fact(a, f"{root.rstrip('/')}/payments")
    write_commitment_fact(a, f"{root.rstrip('/')}/commitments")


def with_stored_facts(a: Audit, root: str) -> Audit:
    paid = with_stored_fact(a, f"{root.rstrip('/')}/payments")
    return with_stored_commitments(paid, f"{root.rstrip('/')}/commitments")


def with_tables_once(a: Audit, columns: dict[str, tuple[str, ...]]) -> Audit:
    """The audit with these columns of its tables in the shared folder, each written when it is first read.

    For jobs that read a table in many parts: its source is read once.  Tables laid out by
    commitment stay where they lie, as the copies would lose that.
    """
    if a.colocated:
        return a
    kept: dict[str, DataFrame] = {}

    def read(name: str, wanted: tuple[str, ...]) -> DataFrame:
        if not wanted or not set(wanted) <= set(columns.get(name, ())):
            return a.reader(name, wanted)
        if name not in kept:
            kept[name] = session.written(a.reader(name, columns[name]), name)
        return kept[name].select(*wanted)

    return replace(a, reader=read)


def with_sums_once(a: Audit) -> Audit:
    """The audit with its sums of payments and of liquidations per commitment in the shared folder."""
    if a.commitment_fact is not None or a.colocated:
        return a
    paid, delivered = facts.paid_totals(a), facts.liquidation_totals(a)
    return replace(a, sums_paid=session.written(paid, "paid"), sums_delivered=session.written(delivered, "delivered"))
