"""The declared keys and references checked load by load, from counts of key values.

The state holds, for every column that a rule names, how often each value occurs, in
buckets by value.  Counts of a load are added to it: counts merge, so a load reads its
own rows and the buckets of their values, and none of the rows that came before.  A
child's value and the parent's lie in one bucket, so references are checked there too.
What a load changes is the difference of the violations in its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lupafiscal.audit import Audit
from lupafiscal.functions.joins import lacking
from lupafiscal.plans.versions import BucketStore
from lupafiscal.schemas import FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_COLUMNS

VALUES = "values"
STATE = StructType([
    StructField("tabela", StringType()), StructField("coluna", StringType()),
    StructField("chave", StringType()), StructField("ocorrencias", LongType()),
])


def counted_columns() -> list[tuple[str, str]]:
    named = {*PRIMARY_KEYS.items(), *UNIQUE_COLUMNS.items()}
    named |= {(fk.table, fk.column) for fk in FOREIGN_KEYS} | {(fk.parent, fk.parent_column) for fk in FOREIGN_KEYS}
    return sorted(named)


def value_counts(a: Audit) -> DataFrame:
    """How often each value occurs in each column that a rule names; combined before the shuffle."""
    parts = [
        a.table(table, column).groupBy(F.col(column).cast("string").alias("chave")).agg(F.count("*").alias("ocorrencias"))
        .select(F.lit(table).alias("tabela"), F.lit(column).alias("coluna"), "chave", "ocorrencias")
        for table, column in counted_columns()
    ]
    return reduce(DataFrame.unionByName, parts)


def _of(columns: dict[str, str] | list[tuple[str, str]]) -> Column:
    pairs = columns.items() if isinstance(columns, dict) else columns
    return reduce(Column.__or__, [(F.col("tabela") == t) & (F.col("coluna") == c) for t, c in pairs])


def repeated(values: DataFrame, columns: dict[str, str]) -> DataFrame:
    """As ``d01`` and ``d02`` list them: null and repeated values."""
    wrong = F.col("chave").isNull() | (F.col("ocorrencias") > 1)
    return values.filter(_of(columns) & wrong).select("tabela", "coluna", "chave", "ocorrencias")


def orphans(values: DataFrame) -> DataFrame:
    """As ``d04`` lists them: values of a child's column that its parent's lacks."""
    def of(fk):
        children = values.filter(_of([(fk.table, fk.column)]) & F.col("chave").isNotNull())
        parents = values.filter(_of([(fk.parent, fk.parent_column)])).select("chave")
        return lacking(children, parents, "chave").select(
            F.lit(fk.name).alias("restricao"), "chave", F.col("ocorrencias").alias("linhas"))

    return reduce(DataFrame.unionByName, [of(fk) for fk in FOREIGN_KEYS])


def violations(values: DataFrame) -> DataFrame:
    """All of them: ``regra``, ``onde``, ``chave`` and ``linhas``."""
    def listed(rule: str, columns: dict[str, str]) -> DataFrame:
        return repeated(values, columns).select(
            F.lit(rule).alias("regra"), F.concat_ws(".", "tabela", "coluna").alias("onde"), "chave",
            F.col("ocorrencias").alias("linhas"))

    references = orphans(values).select(F.lit("REFERENCIA").alias("regra"), F.col("restricao").alias("onde"), "chave", "linhas")
    return listed("CHAVE_PRIMARIA", PRIMARY_KEYS).unionByName(listed("UNICA", UNIQUE_COLUMNS)).unionByName(references)


class KeyState:
    """``root`` holds the state; ``buckets`` never changes for one root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.store = spark, BucketStore(spark, root, buckets)

    def add(self, new: Audit) -> DataFrame:
        """Counts the rows of ``new`` in; the violations that came, went or changed by them.

        ``linhas_antes`` and ``linhas_depois``: rows that break the rule, null if none.
        """
        load = self.store.last() + 1
        counts = value_counts(new).withColumn("bucket", self.store.bucket("chave"))
        self.store.write("counts", counts, load)
        typed = StructType([*STATE.fields, StructField("bucket", IntegerType())])
        fresh = self.spark.read.schema(typed).parquet(f"{self.store.root}/counts/load={load}")
        touched = sorted(row.bucket for row in fresh.select("bucket").distinct().collect())  # buckets at most
        old = self.store.read(VALUES, STATE, touched)
        merged = old.unionByName(fresh.select(old.columns)).groupBy("tabela", "coluna", "chave", "bucket").agg(
            F.sum("ocorrencias").alias("ocorrencias"))
        self.store.write(VALUES, merged, load)
        self.store.commit(load, {VALUES: touched})
        return self._changes(old, self.store.read(VALUES, STATE, touched))

    def _changes(self, old: DataFrame, now: DataFrame) -> DataFrame:
        before = violations(old).withColumnRenamed("linhas", "linhas_antes").alias("x")
        after = violations(now).withColumnRenamed("linhas", "linhas_depois").alias("y")
        same = reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("regra", "onde", "chave")])
        both = before.join(after, same, "full")
        changed = both.filter(~F.col("linhas_antes").eqNullSafe(F.col("linhas_depois")))
        return changed.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("regra", "onde", "chave")],
                              "linhas_antes", "linhas_depois")

    def values(self) -> DataFrame:
        return self.store.read(VALUES, STATE).drop("bucket")
