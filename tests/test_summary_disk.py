"""The summary doesn't keep on disk what its parts have shuffled, and repeats payments as before."""

from __future__ import annotations

import time

import pytest

from lupafiscal import run, session
from lupafiscal.operators import report
from lupafiscal.plans import facts
from tests import tables


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffles_are_gone_when_the_summary_is_ready(spark):
    audit = tables.audit(spark, tables.random_tables(3, 60))
    setting = spark.conf.get(session.FREE_SHUFFLES)
    before = shuffle_files(spark)
    found = run("s01_audit_summary", audit)
    assert spark.conf.get(session.FREE_SHUFFLES) == setting
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # removed by another thread
        time.sleep(0.1)
    assert not left
    assert len(found.collect()) == 31


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_of_payments_without_liquidation_only(spark, seed):
    """Invoice payments that share a payment, or name none, repeat and flag it as the whole join does."""
    rows = tables.random_tables(seed, 60)
    rows["nfe_pagamento"] += [*rows["nfe_pagamento"], *rows["nfe_pagamento"][:9], (None, "N1", "PIX", tables.m(1)), (None, "N1", "PIX", tables.m(1))]
    audit = tables.audit(spark, rows)
    payments = facts.payments(audit, contract="left", liquidation=facts.FLAG)
    flags = ["id_pagamento", "id_empenho", "valor_pago", "tem_liquidacao",
             "not tem_liquidacao and tem_registro_nfe", "not tem_liquidacao and tem_nfe_pagamento"]
    want = facts.with_invoice_flags(audit, payments).selectExpr(*flags)
    got = report._flagged(audit, payments).selectExpr(*flags)
    assert tables.rows_of(got) == tables.rows_of(want)
    assert want.filter("tem_liquidacao").count() > payments.filter("tem_liquidacao").count()
