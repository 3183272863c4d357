"""The eight tables as Parquet folders below one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lupafiscal.audit import Audit
from lupafiscal.schemas import SCHEMAS


def open_audit(spark: SparkSession, root: str) -> Audit:
    """Schemas are given, so no file is opened to find them; columns and filters reach
    the scan."""
    def read(name: str, columns: tuple[str, ...]) -> DataFrame:
        table = spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
        return table.select(*(columns or ["*"]))

    def delivered(name: str, columns: tuple[str, ...]) -> DataFrame:
        return spark.read.parquet(f"{root.rstrip('/')}/{name}").select(*(columns or ["*"]))

    return Audit(spark, read, as_delivered=delivered)


def write_tables(a: Audit, root: str, mode: str = "errorifexists", leave_out: tuple[str, ...] = ()) -> None:
    """Commitments are laid out by year, the other tables as they come."""
    for name, schema in SCHEMAS.items():
        if name in leave_out:
            continue
        rows = a.table(name, *schema.names)
        writer = rows.write.mode(mode)
        if name == "empenho":
            # one task per year would hold a whole year; Spark splits large years itself
            writer = rows.hint("rebalance", "ano").write.mode(mode).partitionBy("ano")
        writer.parquet(f"{root.rstrip('/')}/{name}")
