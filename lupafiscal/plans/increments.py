"""The facts kept up to date load by load, without building them anew.

Commitments, payments and liquidations are kept in buckets by commitment, the other
tables as they come.  A load adds rows to the tables.  What it can change in the facts
lies in the buckets of the commitments it names, directly or through a contract, an
invoice or an invoice payment; a late liquidation thus also changes the flags of older
payments.  Those buckets alone are computed again, from their own rows, and rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupafiscal.audit import Audit
from lupafiscal.functions.joins import having
from lupafiscal.plans import store
from lupafiscal.plans.versions import BucketStore
from lupafiscal.schemas import SCHEMAS

BY_COMMITMENT = ("empenho", "pagamento", "liquidacao_nota_fiscal")
PAYMENTS, COMMITMENTS = "payment_fact", "commitment_fact"


class Facts:
    """``root`` holds the tables and both facts; ``buckets`` never changes for one root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = BucketStore(spark, f"{self.root}/facts", buckets)

    def _table(self, name: str, upto: int, touched: list[int] | None = None) -> DataFrame:
        """Rows of the loads up to one; of some buckets alone where the table is kept in buckets."""
        schema, paths = SCHEMAS[name], [f"{self.root}/{name}/load={k}" for k in range(1, upto + 1)]
        rows = self.spark.read.schema(_with_bucket(name)).option("basePath", f"{self.root}/{name}").parquet(*paths)
        if name in BY_COMMITMENT and touched is not None:
            rows = rows.filter(F.col("bucket").isin(touched))
        return rows.select(schema.names)

    def _audit(self, upto: int, touched: list[int] | None = None) -> Audit:
        return Audit(self.spark, lambda name, columns: self._table(name, upto, touched).select(*(columns or ["*"])))

    def _append(self, new: Audit, load: int) -> None:
        for name, schema in SCHEMAS.items():
            rows, path = new.table(name, *schema.names), f"{self.root}/{name}/load={load}"
            if name in BY_COMMITMENT:
                rows = rows.withColumn("bucket", self.store.bucket("id_empenho")).hint("rebalance", "bucket")
                rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
            else:
                rows.write.mode("overwrite").parquet(path)

    def _touched(self, load: int) -> list[int]:
        """Buckets of the commitments that a load's rows can change anything about."""
        new, whole = self._load(load), self._audit(load)
        named = [new.table(name, "id_empenho") for name in BY_COMMITMENT]
        contracts = new.table("contrato", "id_contrato")
        invoices = new.table("nfe", "chave_nfe").withColumnRenamed("chave_nfe", "chave_danfe")
        recorded = new.table("nfe_pagamento", "id").withColumnRenamed("id", "id_pagamento")
        named += [
            having(whole.table("empenho", "id_empenho", "id_contrato"), contracts, "id_contrato"),
            having(whole.table("liquidacao_nota_fiscal", "id_empenho", "chave_danfe"), invoices, "chave_danfe"),
            having(whole.table("pagamento", "id_empenho", "id_pagamento"), recorded, "id_pagamento"),
        ]
        keys = reduce(DataFrame.unionByName, [rows.select("id_empenho") for rows in named])
        found = keys.select(self.store.bucket("id_empenho").alias("bucket")).distinct().collect()  # buckets at most
        return sorted(row.bucket for row in found)

    def _load(self, load: int) -> Audit:
        def read(name: str, columns: tuple[str, ...]) -> DataFrame:
            rows = self.spark.read.schema(_with_bucket(name)).parquet(f"{self.root}/{name}/load={load}")
            return rows.select(*(columns or SCHEMAS[name].names))

        return Audit(self.spark, read)

    def add(self, new: Audit) -> list[int]:
        """Adds the rows of all tables of ``new`` and brings the facts up to date; the buckets it rewrote."""
        load = self.store.last() + 1
        self._append(new, load)
        touched = self._touched(load)
        part = self._audit(load, touched)
        for name, fact in ((PAYMENTS, store.payment_fact(part)), (COMMITMENTS, store.commitment_fact(part))):
            self.store.write(name, fact.withColumn("bucket", self.store.bucket("id_empenho")), load)
        self.store.commit(load, {PAYMENTS: touched, COMMITMENTS: touched})
        return touched

    def audit(self) -> Audit:
        """The tables of all committed loads, with both facts."""
        whole = self._audit(self.store.last())
        facts = [
            self.store.read(name, fact.schema).drop("bucket")
            for name, fact in ((PAYMENTS, store.payment_fact(whole)), (COMMITMENTS, store.commitment_fact(whole)))
        ]
        return whole.with_payment_fact(facts[0]).with_commitment_fact(facts[1])


def _with_bucket(name: str) -> str:
    """The table's columns, and the bucket where it is kept in buckets."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name])
    return f"{fields}, bucket int" if name in BY_COMMITMENT else fields
