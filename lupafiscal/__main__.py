"""Run checks over Parquet, CSV or database tables and write each result."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from lupafiscal import CHECKS, run, session
from lupafiscal.audit import Audit
from lupafiscal.plans import store
from lupafiscal.schemas import SCHEMAS
from lupafiscal.sources import jdbc, parquet, ptbr_csv


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("lupafiscal", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with one Parquet folder per table")
    source.add_argument("--csv-tables", help="folder with one Brazilian-format CSV folder per table")
    source.add_argument("--jdbc", metavar="URL", help="database with the tables; see --properties")
    parser.add_argument("--quarantine", metavar="PATH", help="load what can be read of CSV tables, write bad lines here")
    parser.add_argument("--properties", metavar="FILE", help="JSON object: driver, user, password and the like")
    parser.add_argument("--slices", type=int, default=64, help="parallel reads of each database table")
    parser.add_argument("--input-bytes", type=int, help="size of the largest table's columns; measured for files")
    parser.add_argument("--out", required=True, help="folder for one result folder per check")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--new-fact", metavar="PATH", help="write the payment and commitment facts here, then use them")
    parser.add_argument("--fact", metavar="PATH", help="use the facts written here before")
    parser.add_argument("checks", nargs="*", metavar="check", help="names; all reports if none is given")
    options = parser.parse_args(argv)
    unknown = sorted(set(options.checks) - set(CHECKS))
    if unknown:
        parser.error(f"unknown checks: {', '.join(unknown)}")
    return options


def opened(options: argparse.Namespace) -> Audit:
    """The tables the options name, in a session sized for them."""
    spark = session.build()
    root = options.tables or options.csv_tables
    if options.input_bytes:
        session.fit(spark, options.input_bytes)
    elif root:
        session.fit(spark, max(session.stored_bytes(spark, f"{root.rstrip('/')}/{name}") for name in SCHEMAS))
    if options.tables:
        return parquet.open_audit(spark, options.tables)
    if options.csv_tables:
        if options.quarantine:
            ptbr_csv.write_quarantine(spark, options.csv_tables, options.quarantine)
        return ptbr_csv.open_audit(spark, options.csv_tables, leave_bad_lines=bool(options.quarantine))
    properties = json.loads(Path(options.properties).read_text()) if options.properties else {}
    even = jdbc.find_predicates(spark, options.jdbc, properties, options.slices)
    return jdbc.open_audit(spark, options.jdbc, properties, predicates=even)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    audit = opened(options)
    if options.new_fact:
        store.write_facts(audit, options.new_fact)
    fact = options.new_fact or options.fact
    if fact:
        audit = store.with_stored_facts(audit, fact)
    # the two exchange checks only write the report once more
    names = options.checks or [n for n in sorted(CHECKS) if n not in ("m02_csv_sink", "m03_csv_source")]
    for name in names:
        path = f"{options.out.rstrip('/')}/{name}"
        if options.format == "csv":
            ptbr_csv.write(run(name, audit), path)
        else:
            run(name, audit).write.parquet(path)


if __name__ == "__main__":
    main()
