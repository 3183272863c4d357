"""Facts kept up load by load equal facts built from all rows at once."""

from __future__ import annotations


import pytest

from lupafiscal import CHECKS, run
from lupafiscal.plans import increments, store
from tests import tables

BUCKETS = 8


def split(rows: dict, parts: int) -> list[dict]:
    """Rows dealt over loads in turn, so that most things arrive after what refers to them."""
    return [{name: of[k::parts] for name, of in rows.items()} for k in range(parts)]


def same(a, b):
    assert tables.rows_of(a) == tables.rows_of(b)


@pytest.mark.parametrize("seed", [3])
def test_after_some_loads_as_built_at_once(spark, tmp_path, seed):
    rows = tables.random_tables(seed, 40)
    facts = increments.Facts(spark, str(tmp_path / "kept"), BUCKETS)
    for part in split(rows, 4):
        facts.add(tables.audit(spark, part))
    kept, whole = facts.audit(), tables.audit(spark, rows)
    same(kept.payment_fact, store.payment_fact(whole))
    same(kept.commitment_fact, store.commitment_fact(whole))


EMPTY = {name: [] for name in tables.hand_made()}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("facts") / "kept")
    facts = increments.Facts(spark, root, BUCKETS)
    facts.add(tables.audit(spark, tables.hand_made()))
    return facts


@pytest.mark.parametrize("late", [
    {"liquidacao_nota_fiscal": [(90, "N90", tables.d(60), tables.m(5), "E2")]},
    {"nfe": [(9, "N9", "9", None, "1", tables.m(5))]},
    {"nfe_pagamento": [("P9", "N50", "PIX", tables.m(1))]},
    {"contrato": [(77, tables.m(9), tables.d(1), "x", 1, 10)]},
    {"pagamento": [("P77", "E404", tables.d(1), tables.m(3)), ("P78", None, tables.d(1), tables.m(3))]},
    {"empenho": [("E404", 2024, tables.d(1), "1", "A", tables.m(2), 1, 77)]},
    {},
], ids=lambda late: next(iter(late), "nothing"))
def test_a_late_row_changes_its_commitments_bucket_alone(spark, loaded, late):
    """One load after another; each is compared with a build of all rows so far."""
    before = loaded.store.versions()
    touched = loaded.add(tables.audit(spark, EMPTY | late))
    after = loaded.store.versions()
    assert len(touched) <= 2
    for name in (increments.PAYMENTS, increments.COMMITMENTS):
        changed = {b for b in after[name] if after[name][b] != before[name].get(b)}
        assert changed == set(touched)
    kept = loaded.audit()
    whole = loaded._audit(loaded.store.last())
    same(kept.payment_fact, store.payment_fact(whole))
    same(kept.commitment_fact, store.commitment_fact(whole))


def test_only_touched_buckets_are_read_and_written(spark, loaded):
    late = {"liquidacao_nota_fiscal": [(91, "N91", tables.d(61), tables.m(5), "E7")]}
    (bucket,) = loaded.add(tables.audit(spark, EMPTY | late))
    load = loaded.store.last()
    part = loaded._audit(load, [bucket])
    for name in increments.BY_COMMITMENT:
        text = part.table(name)._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(bucket" in text or f"= {bucket})" in text
    written = spark.read.parquet(f"{loaded.root}/facts/{increments.PAYMENTS}/load={load}")
    assert {r.bucket for r in written.select("bucket").distinct().collect()} == {bucket}


def test_a_load_that_failed_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    rows = tables.hand_made()
    facts = increments.Facts(spark, str(tmp_path / "kept"), BUCKETS)
    first, second = split(rows, 2)
    facts.add(tables.audit(spark, first))
    before = tables.rows_of(facts.audit().payment_fact)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(facts.store, "commit", fails)
        with pytest.raises(RuntimeError):
            facts.add(tables.audit(spark, second))
    assert tables.rows_of(facts.audit().payment_fact) == before
    facts.add(tables.audit(spark, second))
    same(facts.audit().payment_fact, store.payment_fact(tables.audit(spark, rows)))


@pytest.mark.parametrize("key", ["q04", "q24", "s01"])
def test_checks_on_kept_facts(spark, tmp_path, key):
    rows = tables.random_tables(9, 40)
    facts = increments.Facts(spark, str(tmp_path / "kept"), BUCKETS)
    for part in split(rows, 2):
        facts.add(tables.audit(spark, part))
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    assert tables.rows_of(run(name, facts.audit())) == tables.rows_of_sql(tables.database(rows), name)
