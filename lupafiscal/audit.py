"""Handle on the eight tables that every check takes as its only argument."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# (table name, wanted columns) -> DataFrame with exactly those columns
TableReader = Callable[[str, tuple[str, ...]], DataFrame]


@dataclass(frozen=True)
class Audit:
    """Where the tables come from, and optionally a payment fact already written.

    ``payment_fact`` is what ``plans.store.write_payment_fact`` wrote; with it
    the payment checks scan one table instead of joining four.  ``commitment_fact``
    is likewise what ``write_commitment_fact`` wrote: payments and liquidations
    summed per commitment.  ``sums_paid`` and ``sums_delivered`` are ``facts.paid_totals`` and
    ``facts.liquidation_totals``, already written.  ``report`` is
    the folder ``operators.exchange.write_report`` wrote, for the checks that
    read it back.  ``as_delivered`` reads a table with the types its source has,
    for the checks of what does not fit.  ``colocated``: commitments, payments and
    liquidations are laid out by commitment, so that joins by it move none of them.
    """

    spark: SparkSession
    reader: TableReader
    payment_fact: DataFrame | None = None
    commitment_fact: DataFrame | None = None
    sums_paid: DataFrame | None = None
    sums_delivered: DataFrame | None = None
    report: str | None = None
    as_delivered: TableReader | None = None
    colocated: bool = False

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.reader(name, columns)

    def delivered(self, name: str, *columns: str) -> DataFrame:
        return (self.as_delivered or self.reader)(name, columns)

    def with_payment_fact(self, fact: DataFrame) -> Audit:
        return replace(self, payment_fact=fact)

    def with_commitment_fact(self, fact: DataFrame) -> Audit:
        return replace(self, commitment_fact=fact)

    def with_report(self, path: str) -> Audit:
        return replace(self, report=path)

    @classmethod
    def over(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Audit:
        return cls(spark, lambda name, columns: tables[name].select(*(columns or ["*"])))
