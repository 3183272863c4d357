"""The rules the table definitions declare, as jobs that list what breaks them.

Every rule has a list of offending values and a summary with one row per rule,
so that a clean table also shows that it was checked.  Keys are counted before
they are shuffled; a value that fills most of a table arrives as few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lupafiscal.audit import Audit
from lupafiscal.functions import bitmaps
from lupafiscal.functions.joins import distinct_keys, lacking
from lupafiscal.functions.money import is_bad_money
from lupafiscal.operators.registry import check
from lupafiscal.schemas import (
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    SCHEMAS,
    TEXT_LENGTHS,
    UNIQUE_COLUMNS,
    ForeignKey,
    money_columns,
    required_columns,
)


def _too_large(rows: DataFrame, column: str):
    """An amount, as its source delivers it, that numeric(15,2) cannot hold or that is no number."""
    if isinstance(rows.schema[column].dataType, T.StringType):
        return is_bad_money(column)
    return F.col(column).isNotNull() & F.col(column).try_cast("decimal(15,2)").isNull()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _value_counts(a: Audit, table: str, column: str) -> DataFrame:
    return (
        a.table(table, column)
        .groupBy(F.col(column).alias("chave"))
        .agg(F.count("*").alias("ocorrencias"))
        .select(F.lit(table).alias("tabela"), F.lit(column).alias("coluna"),
                F.col("chave").cast("string"), "ocorrencias")
    )


def repeated_values(a: Audit, columns: dict[str, str]) -> DataFrame:
    counts = _union([_value_counts(a, t, c) for t, c in columns.items()])
    return counts.filter(F.col("chave").isNull() | (F.col("ocorrencias") > 1))


def repeated_summary(a: Audit, columns: dict[str, str]) -> DataFrame:
    null, n = F.col("chave").isNull(), F.col("ocorrencias")
    repeated = ~null & (n > 1)
    zero = F.lit(0)
    return _union([
        _value_counts(a, t, c).groupBy("tabela", "coluna").agg(
            F.sum("ocorrencias").alias("linhas"),
            F.coalesce(F.sum(F.when(null, n)), zero).alias("chaves_nulas"),
            F.count_if(repeated).alias("chaves_repetidas"),
            F.coalesce(F.sum(F.when(repeated, n - 1)), zero).alias("linhas_excedentes"),
        )
        for t, c in columns.items()
    ])


@check("d01_primary_key_violations")
def primary_key_violations(a: Audit) -> DataFrame:
    return repeated_values(a, PRIMARY_KEYS)


@check("d01b_primary_key_summary")
def primary_key_summary(a: Audit) -> DataFrame:
    return repeated_summary(a, PRIMARY_KEYS)


@check("d02_unique_violations")
def unique_violations(a: Audit) -> DataFrame:
    return repeated_values(a, UNIQUE_COLUMNS)


@check("d02b_unique_summary")
def unique_summary(a: Audit) -> DataFrame:
    return repeated_summary(a, UNIQUE_COLUMNS)


@check("d03_not_null_violations")
def not_null_violations(a: Audit) -> DataFrame:
    """One pass per table."""
    def of(table: str) -> DataFrame:
        columns = required_columns(table)
        counts = a.table(table, *columns).agg(
            F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
        return counts.selectExpr(f"'{table}' as tabela", "_rows as linhas",
                                 f"stack({len(columns)}, {pairs}) as (coluna, nulos)")

    return _union([of(t) for t in SCHEMAS])


def _child_counts(a: Audit, fk: ForeignKey) -> DataFrame:
    return a.table(fk.table, fk.column).groupBy(F.col(fk.column).alias("chave")).agg(
        F.count("*").alias("linhas"))


def _is_integer(fk: ForeignKey) -> bool:
    return isinstance(SCHEMAS[fk.table][fk.column].dataType, T.IntegralType)


def _orphan_counts(a: Audit, fk: ForeignKey) -> DataFrame:
    """Integer references are compared as bitmaps by range, so that sound ones shuffle no keys."""
    if _is_integer(fk):
        children, parents = a.table(fk.table, fk.column), a.table(fk.parent, fk.parent_column)
        found = bitmaps.missing(children, fk.column, parents, fk.parent_column)
        found = found.groupBy(F.col(fk.column).alias("chave")).agg(F.count("*").alias("linhas"))
    else:
        parents = distinct_keys(a.table(fk.parent, fk.parent_column), fk.parent_column, "chave")
        found = lacking(_child_counts(a, fk).filter(F.col("chave").isNotNull()), parents, "chave")
    return found.select(F.lit(fk.name).alias("restricao"), F.col("chave").cast("string").alias("chave"), "linhas")


@check("d04_foreign_key_orphans")
def foreign_key_orphans(a: Audit) -> DataFrame:
    return _union([_orphan_counts(a, fk) for fk in FOREIGN_KEYS])


@check("d04b_foreign_key_summary")
def foreign_key_summary(a: Audit) -> DataFrame:
    zero = F.lit(0).cast("long")

    def of_integers(fk: ForeignKey) -> DataFrame:
        rows = a.table(fk.table, fk.column).agg(
            F.count("*").alias("linhas"), F.count_if(F.col(fk.column).isNull()).alias("nulas"),
            zero.alias("linhas_orfas"), zero.alias("chaves_orfas"))
        orphans = _orphan_counts(a, fk).agg(
            zero.alias("linhas"), zero.alias("nulas"), F.coalesce(F.sum("linhas"), zero).alias("linhas_orfas"),
            F.count("*").alias("chaves_orfas"))
        figures = ("linhas", "nulas", "linhas_orfas", "chaves_orfas")
        return rows.unionByName(orphans).agg(*[F.sum(c).alias(c) for c in figures]).withColumn("restricao", F.lit(fk.name))

    def of_texts(fk: ForeignKey) -> DataFrame:
        parents = distinct_keys(a.table(fk.parent, fk.parent_column), fk.parent_column, "chave")
        found = parents.withColumn("_found", F.lit(True))
        orphan = F.col("chave").isNotNull() & F.col("_found").isNull()
        return _child_counts(a, fk).join(found, "chave", "left").agg(
            F.coalesce(F.sum("linhas"), zero).alias("linhas"),
            F.coalesce(F.sum(F.when(F.col("chave").isNull(), F.col("linhas"))), zero).alias("nulas"),
            F.coalesce(F.sum(F.when(orphan, F.col("linhas"))), zero).alias("linhas_orfas"),
            F.count_if(orphan).alias("chaves_orfas"),
        ).withColumn("restricao", F.lit(fk.name))

    return _union([of_integers(fk) if _is_integer(fk) else of_texts(fk) for fk in FOREIGN_KEYS])


@check("d05_domain_violations")
def domain_violations(a: Audit) -> DataFrame:
    """Texts longer than declared and amounts beyond numeric(15,2), as delivered; one pass per table."""
    def of(table: str) -> DataFrame:
        texts, amounts = TEXT_LENGTHS.get(table, {}), money_columns(table)
        source = a.delivered(table, *texts, *amounts)
        measured, rows = [], []
        for column, limit in texts.items():
            size = F.length(column)
            measured += [F.coalesce(F.max(size), F.lit(0)).cast("long").alias(f"{column}_max"),
                         F.count_if(size > limit).alias(f"{column}_bad")]
            rows.append(f"'{column}', 'varchar({limit})', `{column}_max`, `{column}_bad`")
        for column in amounts:
            measured.append(F.count_if(_too_large(source, column)).alias(f"{column}_bad"))
            rows.append(f"'{column}', 'numeric(15,2)', cast(null as bigint), `{column}_bad`")
        return source.agg(*measured).selectExpr(
            f"'{table}' as tabela",
            f"stack({len(rows)}, {', '.join(rows)}) as (coluna, dominio, maior_tamanho, violacoes)")

    return _union([of(t) for t in SCHEMAS])
