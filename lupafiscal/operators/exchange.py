"""The report leaving and entering as Brazilian-format CSV, and the table scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal import session
from lupafiscal.audit import Audit
from lupafiscal.operators.registry import check
from lupafiscal.operators.report import REPORT, irregularity_report
from lupafiscal.schemas import PRIMARY_KEYS, SCHEMAS
from lupafiscal.sources import ptbr_csv, slices

KEY_SLICES = 16


def write_report(a: Audit, path: str) -> Audit:
    """Writes the report to ``path`` once and seals it; the handle it returns reads it from there."""
    ptbr_csv.write(irregularity_report(a), path)
    ptbr_csv.seal(a.spark, path)
    return a.with_report(path)


def _report_path(a: Audit) -> str:
    if a.report is None:
        raise ValueError("write the report first: write_report(audit, path)")
    return a.report


@check("m02_csv_sink")
def csv_sink(a: Audit) -> DataFrame:
    """The written report as its text fields."""
    return ptbr_csv.read_text(a.spark, _report_path(a), REPORT)


@check("m03_csv_source")
def csv_source(a: Audit) -> DataFrame:
    """The written report read back with its types, if all its files are there as written."""
    ptbr_csv.verify(a.spark, _report_path(a))
    return ptbr_csv.read(a.spark, _report_path(a), REPORT)


@check("m05_source_scan")
def source_scan(a: Audit) -> DataFrame:
    """Every table read whole: rows, and rows with all required columns filled."""
    def of(name: str) -> DataFrame:
        required = [f.name for f in SCHEMAS[name] if not f.nullable]
        filled = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in required])
        return a.table(name, *SCHEMAS[name].names).agg(
            F.count("*").alias("linhas"), F.count_if(filled).alias("linhas_completas"),
        ).withColumn("tabela", F.lit(name))

    return reduce(DataFrame.unionByName, [of(name) for name in SCHEMAS])


@check("m06_key_slices")
def key_slices(a: Audit) -> DataFrame:
    """Each table cut into even ranges of its primary key, with the rows of each range.

    Keys are counted, sampled and placed; they are written once, so that the table is read once.
    """
    def of(name: str) -> DataFrame:
        key = PRIMARY_KEYS[name]
        rows = session.written(a.table(name, key), f"{name}-keys")
        return slices.sizes(rows, slices.balanced(rows, key, KEY_SLICES)).withColumn("tabela", F.lit(name))

    return reduce(DataFrame.unionByName, [of(name) for name in SCHEMAS])
