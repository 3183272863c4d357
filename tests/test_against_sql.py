"""Every check against its SQL on small tables that hold the hard cases."""

from __future__ import annotations

import pytest

from lupafiscal import CHECKS, run
from lupafiscal.operators import exchange
from tests import tables

CASES = {
    "hand-made": tables.hand_made(),
    "random": tables.random_tables(seed=7, size=60),
}
RULES = sorted(n for n in CHECKS if n.startswith("d0") or n == "m05_source_scan")


@pytest.fixture(scope="module", params=CASES)
def pair(request, spark):
    case = CASES[request.param]
    return tables.audit(spark, case), tables.database(case)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(pair, name, tmp_path):
    audit, con = pair
    if name in ("m02_csv_sink", "m03_csv_source"):
        audit = exchange.write_report(audit, str(tmp_path / "report"))
    assert tables.rows_of(run(name, audit)) == tables.rows_of_sql(con, name)


@pytest.mark.parametrize("name", RULES)
def test_rules_on_broken_tables(spark, name):
    case = tables.dirty_tables()
    found = tables.rows_of(run(name, tables.audit(spark, case)))
    assert found == tables.rows_of_sql(tables.database(case), name)
    assert found[1]
