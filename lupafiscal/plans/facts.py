"""Building blocks shared by the checks.

Each function returns a lazy DataFrame with one documented grain.  A caller
names only the parts it needs, so that no join is planned for unused columns.
The contract and the existence flags are attached to commitments, before the
payments come in: payments, the largest table, are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupafiscal.audit import Audit
from lupafiscal.functions.joins import distinct_keys, having, lacking, spread_join

WITH, WITHOUT, FLAG, COUNT = "with", "without", "flag", "count"


def contracts(a: Audit, body: str | None = None, supplier: str | None = None) -> DataFrame:
    """One row per contract; ``body`` and ``supplier``: how their names are joined, or None to leave them out."""
    c = a.table("contrato", "id_contrato", "valor", "data", "objeto", "id_entidade", "id_fornecedor")
    rows = c.select(
        "id_contrato",
        F.col("valor").alias("valor_contrato"),
        F.col("data").alias("data_inicio_contrato"),
        "objeto",
        "id_entidade",
        "id_fornecedor",
    )
    return with_names(a, rows, body, supplier)


def with_names(a: Audit, rows: DataFrame, body: str | None, supplier: str | None) -> DataFrame:
    """Adds the names asked for, in joins that Spark can split where one body or supplier has most rows."""
    if body:
        rows = spread_join(rows, bodies(a), "id_entidade", body)
    if supplier:
        rows = spread_join(rows, suppliers(a).select("id_fornecedor", "nome_fornecedor"), "id_fornecedor", supplier)
    return rows


def suppliers(a: Audit) -> DataFrame:
    f = a.table("fornecedor", "id_fornecedor", "nome", "documento")
    return f.select("id_fornecedor", F.col("nome").alias("nome_fornecedor"),
                    F.col("documento").alias("documento_fornecedor"))


def bodies(a: Audit) -> DataFrame:
    en = a.table("entidade", "id_entidade", "nome")
    return en.select("id_entidade", F.col("nome").alias("nome_entidade"))


def payment_rows(a: Audit) -> DataFrame:
    """One row per payment, nothing joined."""
    p = a.table("pagamento", "id_pagamento", "id_empenho", "datapagamentoemp", "valor")
    return p.select(
        "id_pagamento",
        "id_empenho",
        F.col("datapagamentoemp").alias("data_pagamento"),
        F.col("valor").alias("valor_pago"),
    )


def liquidation_rows(a: Audit) -> DataFrame:
    """One row per liquidation, nothing joined."""
    liq = a.table("liquidacao_nota_fiscal", "id_liq_empnf", "chave_danfe", "data_emissao", "valor",
                  "id_empenho")
    return liq.withColumnRenamed("valor", "valor_liquidado")


def liquidated_keys(a: Audit) -> DataFrame:
    if a.commitment_fact is not None:
        return a.commitment_fact.filter("n_liquidacoes > 0").select("id_empenho")
    if a.sums_delivered is not None:
        return a.sums_delivered.filter(F.col("id_empenho").isNotNull()).select("id_empenho")
    return distinct_keys(a.table("liquidacao_nota_fiscal", "id_empenho"), "id_empenho")


def paid_keys(a: Audit) -> DataFrame:
    if a.commitment_fact is not None:
        return a.commitment_fact.filter("n_pagamentos > 0").select("id_empenho")
    return distinct_keys(a.table("pagamento", "id_empenho"), "id_empenho")


def invoiced_keys(a: Audit) -> DataFrame:
    """Commitments with a liquidation whose invoice exists."""
    if a.commitment_fact is not None:
        return a.commitment_fact.filter("tem_nfe").select("id_empenho")
    liq = a.table("liquidacao_nota_fiscal", "chave_danfe", "id_empenho")
    # invoice keys are unique and stay as they are; liquidations may share one, and both
    # sides straight from a shuffle let such a key be split
    issued = a.table("nfe", "chave_nfe").withColumnRenamed("chave_nfe", "chave_danfe")
    return distinct_keys(having(liq, issued, "chave_danfe"), "id_empenho")


def liquidation_totals(a: Audit) -> DataFrame:
    """One row per liquidated commitment; combined before the shuffle."""
    if a.commitment_fact is not None:
        return a.commitment_fact.filter("n_liquidacoes > 0").select(
            "id_empenho", "n_liquidacoes", "total_liquidado", "primeira_liquidacao")
    if a.sums_delivered is not None:
        return a.sums_delivered
    return liquidation_rows(a).groupBy("id_empenho").agg(
        F.count("*").alias("n_liquidacoes"),
        F.sum("valor_liquidado").alias("total_liquidado"),
        F.min("data_emissao").alias("primeira_liquidacao"),
    )


def payment_totals(payments: DataFrame) -> DataFrame:
    """One row per paid commitment; combined before the shuffle."""
    return payments.groupBy("id_empenho").agg(
        F.count("*").alias("n_pagamentos"),
        F.sum("valor_pago").alias("total_pago"),
        F.max("data_pagamento").alias("ultimo_pagamento"),
    )


def paid_totals(a: Audit) -> DataFrame:
    """``payment_totals`` of all payments, also those of unknown commitments."""
    if a.commitment_fact is not None:
        return a.commitment_fact.filter("n_pagamentos > 0").select(
            "id_empenho", "n_pagamentos", "total_pago", "ultimo_pagamento")
    if a.sums_paid is not None:
        return a.sums_paid
    return payment_totals(payment_rows(a))


def _stored_commitments(fact: DataFrame, value: bool, liquidation: str | None, invoiced: bool) -> DataFrame:
    rows = fact.filter("conhecido")
    if liquidation == WITH:
        rows = rows.filter("n_liquidacoes > 0")
    elif liquidation == WITHOUT:
        rows = rows.filter("n_liquidacoes = 0")
    if invoiced:
        rows = rows.filter("tem_nfe")
    wanted = ["id_empenho", "data_empenho", "id_contrato"] + (["valor_empenhado"] if value else [])
    added = {FLAG: [(F.col("n_liquidacoes") > 0).alias("tem_liquidacao")], COUNT: ["n_liquidacoes"]}
    return rows.select(*wanted, *added.get(liquidation, []))


def commitments(
    a: Audit,
    *,
    value: bool = True,
    contract: str | None = "inner",
    liquidation: str | None = None,
    invoiced: bool = False,
    body: str | None = None,
    supplier: str | None = None,
) -> DataFrame:
    """One row per commitment.

    contract: how the contract is joined, or None to leave it out.
    body, supplier: how the names of the contract's are joined to it, or None.
    liquidation: None, or keep rows WITH or WITHOUT one, or add the column
    ``tem_liquidacao`` (FLAG) or ``n_liquidacoes`` (COUNT, 0 if none).
    invoiced: keep rows with a liquidation whose invoice exists.
    """
    if a.commitment_fact is not None:
        e = _stored_commitments(a.commitment_fact, value, liquidation, invoiced)
        return e.join(contracts(a, body, supplier), "id_contrato", contract) if contract else e
    wanted = ["id_empenho", "data_empenho", "id_contrato"] + (["valor"] if value else [])
    e = a.table("empenho", *wanted)
    if value:
        e = e.withColumnRenamed("valor", "valor_empenhado")
    if liquidation == WITH:
        e = having(e, liquidated_keys(a), "id_empenho")
    elif liquidation == WITHOUT:
        e = lacking(e, liquidated_keys(a), "id_empenho")
    elif liquidation == FLAG:
        found = liquidated_keys(a).withColumn("_found", F.lit(True))
        e = e.join(found, "id_empenho", "left").select(
            *e.columns, F.col("_found").isNotNull().alias("tem_liquidacao"))
    elif liquidation == COUNT:
        counts = liquidation_totals(a).select("id_empenho", F.col("n_liquidacoes").alias("_n"))
        e = e.join(counts, "id_empenho", "left").select(
            *e.columns, F.coalesce("_n", F.lit(0)).alias("n_liquidacoes"))
    if invoiced:
        e = having(e, invoiced_keys(a), "id_empenho")
    if contract:
        e = e.join(contracts(a, body, supplier), "id_contrato", contract)
    return e


def payments(
    a: Audit,
    *,
    value: bool = True,
    contract: str | None = "inner",
    liquidation: str | None = None,
    invoiced: bool = False,
    body: str | None = None,
    supplier: str | None = None,
) -> DataFrame:
    """One row per payment with its commitment; options as in ``commitments``.

    Names are attached to contracts, so that payments are moved once.
    """
    if a.payment_fact is not None:
        stored = _from_stored(a.payment_fact, contract, liquidation, invoiced)
        return with_names(a, stored, body, supplier)
    side = commitments(a, value=value, contract=contract, liquidation=liquidation,
                       invoiced=invoiced, body=body, supplier=supplier)
    return by_commitment(a, payment_rows(a), side)


def by_commitment(a: Audit, rows: DataFrame, side: DataFrame) -> DataFrame:
    """Rows with their commitment: moved so that Spark can split a hot one, or where they lie if laid out by it."""
    return rows.join(side, "id_empenho") if a.colocated else spread_join(rows, side, "id_empenho")


def _from_stored(fact: DataFrame, contract: str | None, liquidation: str | None,
                 invoiced: bool) -> DataFrame:
    if contract == "inner":
        fact = fact.filter(F.col("contrato_existe"))
    if liquidation == WITH:
        fact = fact.filter(F.col("tem_liquidacao"))
    elif liquidation == WITHOUT:
        fact = fact.filter(~F.col("tem_liquidacao"))
    if invoiced:
        fact = fact.filter(F.col("tem_nfe"))
    return fact


def without_invoice_payment(a: Audit, rows: DataFrame) -> DataFrame:
    """Payments no invoice payment is recorded for."""
    if "tem_registro_nfe" in rows.columns:
        return rows.filter(~F.col("tem_registro_nfe"))
    recorded = a.table("nfe_pagamento", "id").withColumnRenamed("id", "id_pagamento")
    return lacking(rows, recorded, "id_pagamento")


def with_invoice_flags(a: Audit, rows: DataFrame) -> DataFrame:
    """Adds ``tem_registro_nfe``: the payment has an invoice payment, and
    ``tem_nfe_pagamento``: that invoice payment names an invoice."""
    if "tem_registro_nfe" in rows.columns:
        return rows
    links = a.table("nfe_pagamento", "id", "chave_nfe").select(
        F.col("id").alias("id_pagamento"), F.lit(True).alias("_recorded"),
        F.col("chave_nfe").alias("_chave"))
    return rows.join(links, "id_pagamento", "left").select(
        *rows.columns,
        F.col("_recorded").isNotNull().alias("tem_registro_nfe"),
        F.col("_chave").isNotNull().alias("tem_nfe_pagamento"),
    )


def open_payments(a: Audit, *, value: bool = True) -> DataFrame:
    """Payments of contracted commitments with neither liquidation nor invoice payment.

    Few commitments stay without liquidation, so that is tested first and only
    the payments left are shuffled again, by payment.
    """
    return without_invoice_payment(a, payments(a, value=value, liquidation=WITHOUT))


def days_of_cycle(a: Audit) -> DataFrame:
    """One row per commitment and payment day, with the liquidations around it.

    Replaces pairing every payment with every liquidation of its commitment:
    both are first counted by day, so that a window over one commitment holds
    at most one row per calendar day, however many payments it has.
    ``n_liq_depois`` counts liquidations dated after the day, ``n_liq_ate`` the
    others.
    """
    paid = payment_rows(a).select(
        "id_empenho", F.col("data_pagamento").alias("dia"), "valor_pago",
        F.lit(1).alias("pagamento"), F.lit(0).alias("liquidacao"))
    delivered = a.table("liquidacao_nota_fiscal", "id_empenho", "data_emissao").select(
        "id_empenho", F.col("data_emissao").alias("dia"),
        F.lit(None).cast("decimal(15,2)").alias("valor_pago"),
        F.lit(0).alias("pagamento"), F.lit(1).alias("liquidacao"))
    by_day = paid.unionByName(delivered).groupBy("id_empenho", "dia").agg(
        F.sum("pagamento").alias("n_pagamentos"),
        F.sum("valor_pago").alias("total_pago"),
        F.sum("liquidacao").alias("n_liq"),
    )
    commitment = Window.partitionBy("id_empenho")
    return (
        by_day.withColumn("n_liq_ate", F.sum("n_liq").over(commitment.orderBy("dia")))
        .withColumn("n_liq_depois", F.sum("n_liq").over(commitment) - F.col("n_liq_ate"))
        .filter("n_pagamentos > 0")
        .drop("n_liq")
    )


# Conditions on the columns above.
def over_contract() -> Column:
    return F.col("valor_pago") > F.col("valor_contrato")


def before_contract() -> Column:
    return F.col("data_pagamento") < F.col("data_inicio_contrato")


def before_commitment() -> Column:
    return F.col("data_empenho") > F.col("data_pagamento")
