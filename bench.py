"""Times the headline checks and prints one JSON line.

The eight audit tables are derived from the driver's tables and written as
Parquet once (``write_audit_tables``); each check is then planned and run whole
over them, into a sink that keeps nothing.  ``derived_*`` times a check straight
over the driver's tables, with the derivation inside.
"""

from __future__ import annotations

import json
import os
import sys
import time

from driverdata.mapping import open_audit
from lupafiscal import CHECKS, session
from lupafiscal.plans import store
from lupafiscal.sources import parquet

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "m01_irregularity_report",
    "m04_expense_by_object",
    "q03_full_cycle_commitments",
    "q05_invoice_status_of_unliquidated",
    "q07_fiscal_integrity",
    "q12_real_excess_paid",
    "q16_early_payment_vs_liquidation",
    "q18_commitment_payment_status",
    "q19_liquidation_to_payment_days",
    "q20_finished_payment_dates",
    "q23_full_advances",
    "q24_payment_over_ceiling_summary",
    "q28_contracts_per_supplier",
    "q30_paid_over_invoices",
    "q31_invoice_divergence",
    "q32_modus_operandi",
    "q33_entity_impact",
    "q34_supplier_dossier",
    "g02_early_payment_timeline",
    "g03_consolidated_impact",
    "g04_supplier_risk_ranking",
    "g13_irregular_advances",
    "d04b_foreign_key_summary",
    "s01_audit_summary",
]
# Checks that need nothing but the payment fact once it is written.
ON_STORED_FACT = [
    "q24_payment_over_ceiling_summary",
    "q25_over_contract_by_validity",
    "q33_entity_impact",
    "g02_early_payment_timeline",
    "g04_supplier_risk_ranking",
    "m01_irregularity_report",
]
# Checks timed on both facts.
ON_STORED_FACTS = ["s01_audit_summary", "g03_consolidated_impact", "q18_commitment_payment_status"]

# Checks also timed over the driver's tables.
DERIVED = ["m01_irregularity_report", "q24_payment_over_ceiling_summary"]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session.build(f"local[{CPUS}]", "lupafiscal-bench", **{
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    derived = open_audit(spark, SF_DIR)
    drain(CHECKS["q24_payment_over_ceiling_summary"](derived))  # starts the JVM's compilers

    queries: dict[str, float] = {}

    def measure(name: str, action) -> None:
        queries[name] = timed(action)
        print(name, queries[name], file=sys.stderr)

    tables, fact = (session.new_run_folder(spark, name) for name in ("tables", "fact"))
    measure("write_audit_tables", lambda: parquet.write_tables(derived, tables))
    audit = parquet.open_audit(spark, tables)
    for name in HEADLINE:
        measure(name, lambda: drain(CHECKS[name](audit)))
    measure("write_payment_fact", lambda: store.write_payment_fact(audit, fact))
    stored = store.with_stored_fact(audit, fact)
    for name in ON_STORED_FACT:
        measure(f"stored_{name}", lambda: drain(CHECKS[name](stored)))
    sums = session.new_run_folder(spark, "sums")
    measure("write_commitment_fact", lambda: store.write_commitment_fact(audit, sums))
    stored = store.with_stored_commitments(stored, sums)
    for name in ON_STORED_FACTS:
        measure(f"stored_{name}", lambda: drain(CHECKS[name](stored)))
    for name in DERIVED:
        measure(f"derived_{name}", lambda: drain(CHECKS[name](open_audit(spark, SF_DIR))))

    print(json.dumps({
        "metric": "audit_headline_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
