"""Results worked out by hand on the hand-made tables."""

from __future__ import annotations

from decimal import Decimal

import pytest

from lupafiscal import run
from tests import tables
from tests.tables import d, m


@pytest.fixture(scope="module")
def audit(spark):
    return tables.audit(spark, tables.hand_made())


def found(audit, name, *columns):
    df = run(name, audit)
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()),
                  key=lambda row: [str(v) for v in row])


def test_each_payment_counts_once_per_liquidation(audit):
    # P3, P4, P6, P7: none; P1 and P2 precede E1's commitment: two each; P5 one each way; P9 one later
    assert found(audit, "q16_early_payment_vs_liquidation") == [
        ("LIQUIDOU_ANTES_MAS_EMPENHOU_DEPOIS (ERRO_CONTABIL)", 2, m(120)),
        ("PAGOU_ANTES_DE_LIQUIDAR (GRAVÍSSIMO)", 5, m("500.02")),
        ("SEM_LIQUIDACAO", 4, m(660)),
    ]


def test_full_advance_needs_both_dates(audit):
    assert found(audit, "q23_full_advances") == [(1, 2, m("200.02"))]


def test_supplier_nets_equal_contract_values_once(audit):
    rows = found(audit, "q34_supplier_dossier", "cnpj", "total_recebido", "saldo_excedente_recebido")
    # contracts 10 and 11 are both worth 100
    assert ("11222333000181", m("550.01"), m("450.01")) in rows


def test_supplier_ranking_repeats_an_excess_and_its_variant_does_not(audit):
    column = "saldo_excedente_recebido"
    repeated = dict(found(audit, "g04_supplier_risk_ranking", "cnpj", column))
    once = dict(found(audit, "g04b_supplier_risk_ranking_once", "cnpj", column))
    # excesses 100.01 (E1), 50 (E2) and 100 (E8), two payments each
    assert repeated["11222333000181"] == m("500.02")
    assert once["11222333000181"] == m("250.01")


def test_most_exposed_suppliers_agree_with_the_full_rankings(audit):
    rows = found(audit, "s02_supplier_exposure", "criterio", "lugar", "cnpj", "saldo_excedente_recebido")
    first = {criterio: (cnpj, saldo) for criterio, lugar, cnpj, saldo in rows if lugar == 1}
    assert first == {
        "RECEBIDO_MENOS_CONTRATOS": ("11222333000181", m("450.01")),
        "EXCESSO_POR_PAGAMENTO": ("11222333000181", m("500.02")),
        "EXCESSO_POR_EMPENHO": ("11222333000181", m("250.01")),
    }
    for criterio, name in [("RECEBIDO_MENOS_CONTRATOS", "q34_supplier_dossier"),
                           ("EXCESSO_POR_PAGAMENTO", "g04_supplier_risk_ranking"),
                           ("EXCESSO_POR_EMPENHO", "g04b_supplier_risk_ranking_once")]:
        every = sorted((r[0] for r in found(audit, name, "saldo_excedente_recebido")), reverse=True)
        assert [saldo for own, _, _, saldo in sorted(rows) if own == criterio] == every[:3]


def test_start_day_is_neither_before_nor_during(audit):
    assert found(audit, "q20_finished_payment_dates") == [
        ("PAGAMENTO_ANTES_DA_VIGENCIA", 2, m("160.01")),
        ("PAGAMENTO_NO_INICIO_DA_VIGENCIA", 1, m(100)),
    ]


def test_amount_match_also_takes_unrelated_payments(audit):
    # 60 is P5's over-contract amount; X1 and X2 belong to nobody
    assert found(audit, "q32_modus_operandi") == [("PIX", 3, m(240))]


def test_commitment_without_contract_is_kept_only_where_it_should(audit):
    assert ("E4", None) in found(audit, "g10_payment_before_commitment", "id_empenho", "fornecedor")
    assert all(row[0] != "E4" for row in found(audit, "g09_open_contract_dates", "id_empenho"))


def test_supplier_looked_up_by_contract_number_and_by_contract(audit):
    # faithful: E1 pays 400.02 against 240 after pairing; contract 10 is taken as supplier 10
    faithful = found(audit, "q30_paid_over_invoices")
    assert ("E1", "Alfa", m(240), m("400.02"), m("160.02")) in faithful
    corrected = found(audit, "q30b_paid_over_invoices_corrected")
    assert ("E1", "Alfa", m(120), m("200.01"), m("80.01")) in corrected


def test_report_repeats_over_contract_payment_per_liquidation(audit):
    rows = found(audit, "m01_irregularity_report", "id_empenho", "valor_total_pago",
                 "tipo_irregularidade", "valor_prejuizo_estimado")
    over = "Sobrepreço (Acima do Contrato)"
    assert rows.count(("E1", m("100.01"), over, m("0.01"))) == 2
    assert rows.count(("E3", m(60), over, m(10))) == 2
    assert ("E7", m(500), "Pagamento Sem Liquidação (Fantasma)", m(500)) in rows


def test_chart_table_adds_up(audit):
    rows = found(audit, "m04_expense_by_object")
    report = found(audit, "m01_irregularity_report", "valor_total_pago")
    assert sum(r[1] for r in rows) == sum(r[0] for r in report)
    assert abs(sum(r[3] for r in rows) - 100) < 0.05


def test_document_rules(audit):
    assert found(audit, "r03_supplier_document_validity", "documento", "situacao_documento") == [
        ("00000070000170", "DIGITO_VERIFICADOR_INVALIDO"),
        ("000001200001120", "TAMANHO_INVALIDO"),
        ("11222333000181", "VALIDO"),
        ("12A", "NAO_NUMERICO"),
        ("52998224725", "VALIDO"),
    ]


def test_classes_cover_their_universe(audit):
    """Every payment and commitment falls in exactly one class."""
    def total(name, column):
        return sum(r[0] for r in found(audit, name, column))

    of_contract = 8  # P6 has none
    assert total("q24_payment_over_ceiling_summary", "quantidade_pagamentos") == of_contract
    over = len(found(audit, "c13_over_contract_detail"))
    assert total("q25_over_contract_by_validity", "quantidade_pagamentos") == over
    assert total("q26_over_contract_by_liquidation", "quantidade_pagamentos") == over
    assert total("q18_commitment_payment_status", "quantidade_empenhos") == 8
    paid = set(found(audit, "q04_payments_without_liquidation", "id_empenho"))
    (regular,), = found(audit, "q03_full_cycle_commitments")
    (all_paid,), = found(audit, "q02_commitments_with_payment")
    assert len(paid) + regular == all_paid


def test_orders(audit):
    rows = run("g02_early_payment_timeline", audit).collect()
    days = [r["dias_antecipacao"] for r in rows]
    assert days == sorted(days, reverse=True)
    losses = [r["valor_prejuizo_estimado"] for r in run("m01_irregularity_report", audit).collect()]
    assert losses == sorted(losses, reverse=True) and isinstance(losses[0], Decimal)
    assert [r["data_pagamento"] for r in run("g12_finished_but_early", audit).collect()] == [d(9), d(22)]
