"""The main irregularity report, its chart table and the one-page summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lupafiscal import labels, session
from lupafiscal.audit import Audit
from lupafiscal.functions.money import DIFFERENCE, TOTAL, total
from lupafiscal.operators import invoices, volumes
from lupafiscal.operators.registry import check
from lupafiscal.plans import facts, store
from lupafiscal.plans.facts import COUNT, FLAG
from lupafiscal.schemas import MONEY


# The report's columns, as it is written and read.
REPORT = T.StructType([
    T.StructField("entidade_responsavel", T.StringType()),
    T.StructField("fornecedor", T.StringType()),
    T.StructField("objeto_contrato", T.StringType()),
    T.StructField("id_empenho", T.StringType()),
    T.StructField("id_contrato", T.LongType()),
    T.StructField("valor_teto_contrato", MONEY),
    T.StructField("valor_total_pago", MONEY),
    T.StructField("tipo_irregularidade", T.StringType()),
    T.StructField("valor_prejuizo_estimado", T.DecimalType(18, 2)),
])
# Repetitions of one row that are listed at once.
STEP = 1000


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``vez``; no row holds more than ``STEP`` numbers."""
    last = F.floor((times - 1) / STEP).cast("long")
    steps = rows.withColumn("_times", times.cast("long")).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    low = F.col("_step") * STEP + 1
    numbered = steps.withColumn("vez", F.explode(F.sequence(low, F.least("_times", low + (STEP - 1)))))
    return numbered.drop("_times", "_step")


def irregularities(a: Audit) -> DataFrame:
    """Payments above their contract, once per liquidation, and payments without one, once.

    Liquidations are counted, never paired: no column of theirs is in the report.
    """
    rows = facts.payments(a, value=False, liquidation=COUNT, body="inner", supplier="inner").filter(
        facts.over_contract() | (F.col("n_liquidacoes") == 0))
    return repeated(rows, F.greatest(F.col("n_liquidacoes"), F.lit(1)))


def _kind_and_loss(rows: DataFrame) -> DataFrame:
    """What is left after the filter is over the contract or has no liquidation."""
    over = facts.over_contract()
    return rows.withColumn(
        "tipo_irregularidade",
        F.when(over, F.lit(labels.KIND_OVERPRICE))
        .otherwise(F.lit(labels.KIND_NO_DELIVERY)),
    ).withColumn(
        "valor_prejuizo_estimado",
        F.when(over, F.col("valor_pago") - F.col("valor_contrato"))
        .otherwise(F.col("valor_pago")).cast(DIFFERENCE),
    )


@check("m01_irregularity_report")
def irregularity_report(a: Audit) -> DataFrame:
    return (
        _kind_and_loss(irregularities(a))
        .orderBy(F.desc("valor_prejuizo_estimado"), "id_pagamento", "vez")
        .select(
            F.col("nome_entidade").alias("entidade_responsavel"),
            F.col("nome_fornecedor").alias("fornecedor"),
            F.col("objeto").alias("objeto_contrato"),
            "id_empenho",
            "id_contrato",
            F.col("valor_contrato").alias("valor_teto_contrato"),
            F.col("valor_pago").alias("valor_total_pago"),
            "tipo_irregularidade",
            "valor_prejuizo_estimado",
        )
    )


@check("m04_expense_by_object")
def expense_by_object(a: Audit) -> DataFrame:
    """The report summed by contract object; a row that the report repeats is multiplied.

    The report keeps only contracts whose body and supplier are known.
    """
    times = F.greatest(F.col("n_liquidacoes"), F.lit(1))
    rows = facts.payments(a, value=False, liquidation=COUNT).filter(
        facts.over_contract() | (F.col("n_liquidacoes") == 0))
    known_bodies = facts.bodies(a).select("id_entidade")
    known_suppliers = facts.suppliers(a).select("id_fornecedor")
    sums = (
        _kind_and_loss(rows)
        .filter(F.col("objeto").isNotNull())
        .groupBy("objeto", "id_entidade", "id_fornecedor")
        .agg(F.sum(F.col("valor_pago") * times).alias("pago"),
             F.sum(F.col("valor_prejuizo_estimado") * times).alias("prejuizo"))
        .join(known_bodies, "id_entidade", "left_semi")
        .join(known_suppliers, "id_fornecedor", "left_semi")
        .groupBy(F.col("objeto").alias("objeto_contrato"))
        .agg(total("pago").alias("valor_total_pago"), total("prejuizo").alias("valor_prejuizo_estimado"))
    )
    # both sums are taken, so that the total is built on the shuffle of the rows themselves
    everything = sums.agg(F.struct(F.sum("valor_total_pago").alias("pago"),
                                   F.sum("valor_prejuizo_estimado").alias("prejuizo"))).scalar()
    share = F.col("valor_total_pago").cast("double") / everything["pago"].cast("double")
    return sums.withColumn("percentual_pago", F.round(share * 100, 2)).orderBy(
        F.desc("valor_total_pago"), "objeto_contrato")


def _metrics(one_row: DataFrame, **column_of: str) -> DataFrame:
    """One row of figures as rows (metrica, valor)."""
    pairs = ", ".join(f"'{metric}', cast({column} as {TOTAL})"
                      for metric, column in column_of.items())
    return one_row.selectExpr(f"stack({len(column_of)}, {pairs}) as (metrica, valor)")


def _commitment_figures(a: Audit) -> DataFrame:
    sums = facts.paid_totals(a)
    rows = facts.commitments(a, contract=None, liquidation=FLAG).join(sums, "id_empenho", "left")
    paid = F.coalesce("total_pago", F.lit(0))
    is_paid, held = F.col("n_pagamentos").isNotNull(), F.col("valor_empenhado")
    return _metrics(
        rows.agg(
            F.count("*").alias("todos"),
            F.count_if(is_paid).alias("pagos"),
            F.count_if(~is_paid).alias("nao_pagos"),
            F.count_if(is_paid & F.col("tem_liquidacao")).alias("ciclo"),
            F.count_if(is_paid & ~F.col("tem_liquidacao")).alias("sem"),
            F.count_if(paid > held).alias("maior"),
            F.count_if(paid == held).alias("exato"),
            F.count_if(paid < held).alias("menor"),
        ),
        empenhos_emitidos="todos",
        empenhos_com_pagamento="pagos",
        empenhos_sem_pagamento="nao_pagos",
        empenhos_ciclo_completo="ciclo",
        empenhos_pagos_sem_liquidacao="sem",
        empenhos_pagos_a_maior="maior",
        empenhos_pagos_no_valor="exato",
        empenhos_pagos_a_menor="menor",
    )


def _payments(a: Audit) -> DataFrame:
    """Payments with what the figures need of their commitment, which is written first: its joins' shuffles are then gone."""
    if a.payment_fact is not None or a.colocated:
        return facts.payments(a, contract="left", liquidation=FLAG)
    side = facts.commitments(a, contract="left", liquidation=FLAG).drop("objeto", "id_contrato")
    return facts.by_commitment(a, facts.payment_rows(a), session.written(side, "commitments"))


def _flagged(a: Audit, rows: DataFrame) -> DataFrame:
    """``facts.with_invoice_flags`` where a payment has no liquidation; nothing asks the others for them.

    So only payments without one, the few, are moved by payment.  Invoice payments that share a
    payment repeat the others as well; these are looked up in a table of such payments alone.
    """
    if "tem_registro_nfe" in rows.columns:
        return rows
    links = a.table("nfe_pagamento", "id").withColumnRenamed("id", "id_pagamento")
    shared = links.groupBy("id_pagamento").agg(F.count("*").alias("n")).filter("n > 1")
    shared = session.written(repeated(shared, F.col("n")).select("id_pagamento"), "shared")
    without = facts.with_invoice_flags(a, rows.filter(~F.col("tem_liquidacao")))
    liquidated = rows.filter("tem_liquidacao").join(shared, "id_pagamento", "left")
    no = F.lit(False)
    return without.unionByName(liquidated.withColumn("tem_registro_nfe", no).withColumn("tem_nfe_pagamento", no))


def _payment_figures(a: Audit) -> DataFrame:
    """One pass over the payments, for all figures that need no liquidation date.

    Summed per commitment first; whether its body and supplier are known, which
    the lists of problems and of open commitments ask, is looked up after that.
    """
    rows = _flagged(a, _payments(a))
    over, early = facts.over_contract(), facts.before_contract()
    unliquidated = ~F.col("tem_liquidacao")
    excess = F.col("valor_pago") - F.col("valor_contrato")
    contracted = F.col("valor_contrato").isNotNull()
    problem = contracted & (over | unliquidated)
    still_open = (contracted & unliquidated & ~F.col("tem_registro_nfe")
                  & (F.col("valor_empenhado") > F.col("valor_contrato")))
    per_commitment = rows.groupBy("id_empenho", "id_entidade", "id_fornecedor", "valor_contrato").agg(
        F.count_if(facts.before_commitment()).alias("antes_empenho"),
        F.count_if(early).alias("antes_contrato"),
        F.count_if(over).alias("acima"),
        F.count_if(over & early).alias("acima_antes"),
        F.count_if(over & unliquidated).alias("acima_sem"),
        F.count_if(unliquidated & ~F.col("tem_nfe_pagamento")).alias("sem_nada"),
        F.sum(F.when(over, excess)).alias("excesso"),
        F.max(problem).alias("problema"),
        F.sum(F.when(problem, F.when(over, excess).otherwise(F.col("valor_pago")))).alias("risco"),
        F.sum(F.when(still_open, F.col("valor_pago"))).alias("aberto"),
    )
    body = facts.bodies(a).select("id_entidade", F.lit(True).alias("_body"))
    supplier = facts.suppliers(a).select("id_fornecedor", F.lit(True).alias("_supplier"))
    per_commitment = per_commitment.join(body, "id_entidade", "left").join(
        supplier, "id_fornecedor", "left")
    listed = F.col("_body") & F.col("problema")
    opened = F.col("_supplier") & F.col("aberto").isNotNull()
    counts = ["antes_empenho", "antes_contrato", "acima", "acima_antes", "acima_sem", "sem_nada", "excesso"]
    zero = F.lit(0)
    return _metrics(
        per_commitment.agg(
            *[F.coalesce(F.sum(c), zero).alias(c) for c in counts],
            F.count_if(listed).alias("problemas"),
            F.coalesce(F.sum(F.when(listed, F.col("risco"))), zero).alias("risco"),
            F.count_if(opened).alias("abertos"),
            F.count_if(opened & (F.col("aberto") > F.col("valor_contrato"))).alias("abertos_pagos"),
        ),
        pagamentos_antes_do_empenho="antes_empenho",
        pagamentos_antes_do_contrato="antes_contrato",
        pagamentos_acima_do_contrato="acima",
        pagamentos_acima_do_contrato_antes_da_vigencia="acima_antes",
        pagamentos_acima_do_contrato_sem_liquidacao="acima_sem",
        pagamentos_sem_liquidacao_sem_nfe="sem_nada",
        excesso_sobre_contratos="excesso",
        empenhos_problematicos="problemas",
        impacto_financeiro_total="risco",
        empenhos_abertos_acima_do_contrato="abertos",
        empenhos_abertos_com_excesso_pago="abertos_pagos",
    )


def _day_figures(a: Audit) -> DataFrame:
    """One pass over the payment days, for the figures that compare with liquidations."""
    days = facts.days_of_cycle(a).filter("n_liq_depois > 0").withColumnRenamed("total_pago", "pago")
    rows = days.join(facts.commitments(a, value=False, contract="left"), "id_empenho")
    pairs = F.col("n_pagamentos") * F.col("n_liq_depois")
    advance = F.col("dia") < F.col("data_inicio_contrato")
    zero = F.lit(0)
    return _metrics(
        rows.agg(
            F.coalesce(F.sum(F.when(F.col("data_empenho") > F.col("dia"), pairs)), zero).alias("antes"),
            F.count_distinct(F.when(advance, F.col("id_empenho"))).alias("empenhos"),
            F.coalesce(F.sum(F.when(advance, F.col("pago") * F.col("n_liq_depois"))), zero).alias("valor"),
        ),
        pagamentos_antes_da_liquidacao="antes",
        adiantamentos_completos="empenhos",
        valor_dos_adiantamentos_completos="valor",
    )


# What the parts of the summary read more than once.
READ_OFTEN = {
    "contrato": ("id_contrato", "valor", "data", "objeto", "id_entidade", "id_fornecedor"),
    "empenho": ("id_empenho", "data_empenho", "id_contrato", "valor"),
    "pagamento": ("id_pagamento", "id_empenho", "datapagamentoemp", "valor"),
    "liquidacao_nota_fiscal": ("id_liq_empnf", "chave_danfe", "data_emissao", "valor", "id_empenho"),
    "nfe_pagamento": ("id", "chave_nfe", "tipo_pagamento", "valor_pagamento"),
}


@check("s01_audit_summary")
def audit_summary(a: Audit) -> DataFrame:
    """The headline figures as rows (metrica, valor); each part ends in one row.

    One part runs after the other, so that no two have their shuffle files on disk at once.
    """
    a = store.with_sums_once(store.with_tables_once(a, READ_OFTEN))

    def size(rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n"))

    def alone(part: DataFrame, fact: DataFrame | None = None) -> DataFrame:
        """The part's rows, written; one of a stored fact, which has few shuffles, is left to the result."""
        return session.written(part, "figures") if fact is None else part

    backed = invoices.modus_operandi(a).agg(
        F.sum("frequencia").alias("n"), F.sum("volume_financeiro_suspeito").alias("volume"))
    return reduce(DataFrame.unionByName, [
        alone(_commitment_figures(a), a.commitment_fact),
        alone(_payment_figures(a), a.payment_fact),
        alone(_day_figures(a)),
        alone(_metrics(volumes.total_contracts(a), contratos_registrados="total_contratos")),
        alone(_metrics(size(volumes.contracts_without_commitment(a)), contratos_sem_empenho="n")),
        alone(_metrics(volumes.total_suppliers(a), fornecedores_cadastrados="total_fornecedores")),
        alone(_metrics(size(invoices.invoice_divergence(a)), notas_com_valor_divergente="n")),
        alone(_metrics(size(invoices.paid_over_invoices(a)), empenhos_pagos_acima_das_notas="n")),
        alone(_metrics(backed, pagamentos_irregulares_com_nota="coalesce(n, 0)",
                       volume_irregular_com_nota="coalesce(volume, 0)")),
        alone(_metrics(size(a.table("nfe_pagamento", "id")), registros_de_pagamento_de_nota="n")),
        alone(_metrics(size(invoices.orphan_invoice_payments(a)), pagamentos_de_nota_orfaos="n")),
    ])
