"""The eight tables from a relational database, read in parallel slices.

Connection settings come from the caller only; nothing is stored here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lupafiscal.audit import Audit
from lupafiscal.schemas import PRIMARY_KEYS, SCHEMAS
from lupafiscal.sources.slices import SAMPLE_KEYS, KeyRange, ranges


@dataclass(frozen=True)
class Slices:
    """How one table is cut: a numeric or date column with its range, read by ``count``
    tasks.  The bounds shape the slices and leave no row out."""

    column: str
    lower: str
    upper: str
    count: int


# A column of each table that spreads its rows; text keys cannot be cut by range.
SLICE_COLUMNS = {
    "contrato": "id_contrato",
    "empenho": "data_empenho",
    "liquidacao_nota_fiscal": "id_liq_empnf",
    "nfe": "id",
    "pagamento": "datapagamentoemp",
    "fornecedor": "id_fornecedor",
    "entidade": "id_entidade",
}


def read_options(table: str, url: str, slices: Slices | None, fetch_size: int = 10_000) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true",
               "pushDownAggregate": "true"}
    if slices:
        options |= {
            "partitionColumn": slices.column,
            "lowerBound": slices.lower,
            "upperBound": slices.upper,
            "numPartitions": str(slices.count),
        }
    return options


def bounds_query(table: str) -> str:
    """Lowest and highest value of the slicing column, for ``Slices``."""
    column = SLICE_COLUMNS[table]
    return f"SELECT MIN({column}) AS lower, MAX({column}) AS upper FROM {table}"


def find_slices(spark: SparkSession, table: str, url: str, properties: Mapping[str, str],
                count: int) -> Slices | None:
    """Asks the database for the range; one row comes back."""
    row = spark.read.format("jdbc").options(url=url, query=bounds_query(table), **properties).load().first()
    if row is None or row["lower"] is None:
        return None
    return Slices(SLICE_COLUMNS[table], str(row["lower"]), str(row["upper"]), count)


# How a share of a table's rows is asked for, as PostgreSQL and the SQL standard have it.
SAMPLING = "TABLESAMPLE BERNOULLI ({percent})"


def sample_query(table: str, percent: float, sampling: str = SAMPLING) -> str:
    """Sampled keys with their place in the database's own order, which its comparisons follow too."""
    key = PRIMARY_KEYS[table]
    some = f" {sampling.format(percent=f'{percent:.6f}')}" if percent < 100 else ""
    return f"SELECT {key} AS slice_key, ROW_NUMBER() OVER (ORDER BY {key}) AS place FROM {table}{some} WHERE {key} IS NOT NULL"


def find_ranges(spark: SparkSession, table: str, url: str, properties: Mapping[str, str], count: int,
                sampling: str = SAMPLING) -> list[KeyRange]:
    """Ranges of the primary key, number or text, with about equal numbers of rows.

    The database counts the table and sends about ``SAMPLE_KEYS`` keys.
    """
    def ask(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=query, **properties).load()

    rows = ask(f"SELECT COUNT(*) AS n FROM {table}").first()["n"]
    if not rows:
        return ranges(PRIMARY_KEYS[table], [], count)
    found = ask(sample_query(table, min(100.0, 100.0 * SAMPLE_KEYS / rows), sampling)).collect()
    ordered = [row["slice_key"] for row in sorted(found, key=lambda row: row["place"])]
    return ranges(PRIMARY_KEYS[table], ordered, count)


def find_predicates(spark: SparkSession, url: str, properties: Mapping[str, str], count: int,
                    sampling: str = SAMPLING) -> dict[str, list[str]]:
    """For ``open_audit``: each of the eight tables in about ``count`` even reads."""
    return {
        table: [part.sql() for part in find_ranges(spark, table, url, properties, count, sampling)]
        for table in SCHEMAS
    }


def open_audit(spark: SparkSession, url: str, properties: Mapping[str, str],
               slices: Mapping[str, Slices] | None = None,
               predicates: Mapping[str, list[str]] | None = None) -> Audit:
    """``properties``: driver, user, password and the like, from the caller.

    A table is read in ``slices`` of a range, or by ``predicates``: conditions, a task each,
    that together cover every row exactly once, nulls included.  A table with neither is
    read by one task.
    """
    slices, predicates = slices or {}, predicates or {}
    both = sorted(set(slices) & set(predicates))
    if both:
        raise ValueError(f"slices and predicates for {', '.join(both)}")

    def read(name: str, columns: tuple[str, ...]) -> DataFrame:
        if name in predicates:
            table = spark.read.jdbc(url, name, predicates=predicates[name], properties=dict(properties))
        else:
            options = read_options(name, url, slices.get(name))
            table = spark.read.format("jdbc").options(**options, **properties).load()
        typed = [table[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name]
                 if not columns or f.name in columns]
        return table.select(*typed)

    return Audit(spark, read)
