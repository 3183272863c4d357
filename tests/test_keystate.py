"""Rules checked load by load list what a check of all rows lists."""

from __future__ import annotations

from collections import Counter

import pytest

from lupafiscal import run
from lupafiscal.plans import keystate
from lupafiscal.schemas import PRIMARY_KEYS, UNIQUE_COLUMNS
from tests import tables
from tests.test_increments import EMPTY, split

BUCKETS = 8


def rows_of(df, *columns):
    return Counter(tuple(row[c] for c in columns) for row in df.collect())


@pytest.mark.parametrize("loads", [1, 3])
def test_after_some_loads_as_over_all_rows(spark, tmp_path, loads):
    rows = tables.dirty_tables()
    state = keystate.KeyState(spark, str(tmp_path / "state"), BUCKETS)
    known: dict[tuple, int] = {}
    for part in split(rows, loads):
        for r in state.add(tables.audit(spark, part)).collect():
            key = (r.regra, r.onde, r.chave)
            assert known.get(key) == r.linhas_antes
            known[key] = r.linhas_depois
    whole, values = tables.audit(spark, rows), state.values()
    repeated = ("tabela", "coluna", "chave", "ocorrencias")
    for name, columns in (("d01_primary_key_violations", PRIMARY_KEYS), ("d02_unique_violations", UNIQUE_COLUMNS)):
        assert rows_of(keystate.repeated(values, columns), *repeated) == rows_of(run(name, whole), *repeated)
    orphan = ("restricao", "chave", "linhas")
    found = rows_of(keystate.orphans(values), *orphan)
    assert found and found == rows_of(run("d04_foreign_key_orphans", whole), *orphan)
    # The changes of all loads together are the violations.
    now = {(r.regra, r.onde, r.chave): r.linhas for r in keystate.violations(values).collect()}
    assert now == {k: n for k, n in known.items() if n is not None}


def test_a_load_reads_its_own_rows_and_its_values_buckets(spark, tmp_path):
    state = keystate.KeyState(spark, str(tmp_path / "state"), BUCKETS)
    state.add(tables.audit(spark, tables.hand_made()))
    late = EMPTY | {"nfe_pagamento": [("X9", "N2", "PIX", tables.m(1))]}
    found = state.add(tables.audit(spark, late))
    # N2 is the invoice of P3's payment too: a second one breaks the declared uniqueness.
    assert {tuple(r) for r in found.collect()} == {("UNICA", "nfe_pagamento.chave_nfe", "N2", None, 2)}
    versions = state.store.versions()[keystate.VALUES]
    touched = {b for b, load in versions.items() if load == 2}
    assert 1 <= len(touched) <= 2
    read = state.store.read(keystate.VALUES, keystate.STATE, touched).inputFiles()
    assert all("load=2" in path for path in read)
    rest = state.store.read(keystate.VALUES, keystate.STATE, set(versions) - touched).inputFiles()
    assert rest and all("load=1" in path for path in rest)


def test_a_missing_parent_that_comes_late_ends_the_violation(spark, tmp_path):
    state = keystate.KeyState(spark, str(tmp_path / "state"), BUCKETS)
    child = EMPTY | {"empenho": [("E1", 2024, None, "1", "A", tables.m(1), None, 5)]}
    first = state.add(tables.audit(spark, child)).filter("regra = 'REFERENCIA'").collect()
    assert [(r.onde, r.chave, r.linhas_depois) for r in first] == [("empenho.id_contrato->contrato.id_contrato", "5", 1)]
    parent = EMPTY | {"contrato": [(5, tables.m(1), tables.d(1), "x", None, None)]}
    second = state.add(tables.audit(spark, parent)).filter("regra = 'REFERENCIA'").collect()
    assert [(r.onde, r.chave, r.linhas_antes, r.linhas_depois) for r in second] == [
        ("empenho.id_contrato->contrato.id_contrato", "5", 1, None)]
