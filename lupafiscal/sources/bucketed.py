"""Commitments, payments and liquidations in buckets by commitment, sorted inside.

Stands for an index on the commitment: joins and sums by commitment read the three
tables side by side, bucket by bucket, and move none of them.  A bucket is read by one
task, so a commitment with a large share of all payments is one task's work too; where
there are such, the plain layout, whose joins Spark splits, is the better one.
"""

from __future__ import annotations

import zlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from lupafiscal.audit import Audit
from lupafiscal.schemas import SCHEMAS
from lupafiscal.sources import parquet

KEY = "id_empenho"
BUCKETED = ("empenho", "pagamento", "liquidacao_nota_fiscal")


def _folder(root: str, name: str, buckets: int) -> str:
    return f"{root.rstrip('/')}/{name}-{buckets}"


def _declared(spark: SparkSession, root: str, name: str, buckets: int) -> str:
    """The table's name in the session's catalog, where its layout is declared."""
    path = _folder(root, name, buckets)
    table = f"lupafiscal_{name}_{zlib.crc32(path.encode()):x}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return table


def write_tables(a: Audit, root: str, buckets: int) -> None:
    """Writes the eight tables; the folder must be new.

    ``buckets``: no fewer than the session's shuffle partitions, or Spark deals the rows
    out anew.  Rows are moved to their bucket first, so that each is one file.
    """
    for name in BUCKETED:
        table = _declared(a.spark, root, name, buckets)
        rows = a.table(name, *SCHEMAS[name].names)
        rows.repartition(buckets, KEY).write.insertInto(table)
    parquet.write_tables(a, root, leave_out=BUCKETED)


def open_audit(spark: SparkSession, root: str, buckets: int) -> Audit:
    """The tables as ``write_tables`` left them, in this session or another."""
    plain = parquet.open_audit(spark, root)
    names = {name: _declared(spark, root, name, buckets) for name in BUCKETED}

    def read(name: str, columns: tuple[str, ...]) -> DataFrame:
        if name not in names:
            return plain.table(name, *columns)
        return spark.table(names[name]).select(*(columns or ["*"]))

    return replace(plain, reader=read, as_delivered=read, colocated=True)
