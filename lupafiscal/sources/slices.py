"""Key ranges of about equal numbers of rows, for reads in parallel.

Bounds are keys at regular places of an ordered sample, so that a busy stretch of keys
is cut as finely as its rows ask.  Ranges are half open and follow one another; the
first has all below and the nulls, the last all above, so that together they hold each
row once, whatever the sample missed.  A value that repeats cannot be cut: keys are
meant, which repeat only where a table breaks its declaration.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys in a sample, about; what the driver sorts is bounded by it.
SAMPLE_KEYS = 1 << 14


@dataclass(frozen=True)
class KeyRange:
    """``lower <= column < upper``; an end that is None is open.  ``nulls``: has the nulls too."""

    column: str
    lower: object | None
    upper: object | None
    nulls: bool

    def sql(self) -> str:
        """The condition for a database, in plain SQL."""
        ends = []
        if self.lower is not None:
            ends.append(f"{self.column} >= {literal(self.lower)}")
        if self.upper is not None:
            ends.append(f"{self.column} < {literal(self.upper)}")
        inside = " AND ".join(ends) or f"{self.column} IS NOT NULL"
        return f"({inside} OR {self.column} IS NULL)" if self.nulls else inside

    def condition(self) -> Column:
        """The same for a DataFrame; false or true, never null."""
        column = F.col(self.column)
        ends = [column.isNotNull()]
        if self.lower is not None:
            ends.append(column >= F.lit(self.lower))
        if self.upper is not None:
            ends.append(column < F.lit(self.upper))
        inside = F.coalesce(reduce(Column.__and__, ends), F.lit(False))
        return inside | column.isNull() if self.nulls else inside


def literal(value: object) -> str:
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def ranges(column: str, ordered: Sequence, count: int) -> list[KeyRange]:
    """At most ``count`` ranges, from keys in the order of the system that compares them.

    Equal bounds are taken once; an empty sample gives one range of everything.
    """
    bounds: list = []
    for i in range(1, count):
        key = ordered[i * len(ordered) // count] if len(ordered) else None
        if key is not None and (not bounds or bounds[-1] != key):
            bounds.append(key)
    ends = [None, *bounds, None]
    return [KeyRange(column, low, high, low is None) for low, high in zip(ends, ends[1:], strict=False)]


def sampled_keys(rows: DataFrame, column: str, sample: int = SAMPLE_KEYS) -> list:
    """About ``sample`` keys of a table, or all if it has no more, sorted.

    Chosen by a hash of the key, so that the same table gives the same sample; equal
    keys are chosen together.
    """
    keys = rows.select(F.col(column).alias("key"))
    n = keys.count()
    if n > sample:
        place = F.conv(F.substring(F.md5(F.col("key").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
        keys = keys.filter(place < F.lit((sample << 32) // n))
    return sorted(row.key for row in keys.filter("key is not null").collect())


def balanced(rows: DataFrame, column: str, count: int, sample: int = SAMPLE_KEYS) -> list[KeyRange]:
    return ranges(column, sampled_keys(rows, column, sample), count)


def sizes(rows: DataFrame, cut: Sequence[KeyRange]) -> DataFrame:
    """``fatia``, ``de``, ``ate`` (as texts) and ``linhas`` of each range, from one pass over the rows."""
    counts = rows.agg(*[F.count_if(part.condition()).alias(f"n{i}") for i, part in enumerate(cut)])
    listed = [
        F.struct(F.lit(i).alias("fatia"), *[F.lit(None if end is None else str(end)).cast("string").alias(name)
                                            for name, end in (("de", part.lower), ("ate", part.upper))],
                 F.col(f"n{i}").alias("linhas"))
        for i, part in enumerate(cut)
    ]
    return counts.select(F.inline(F.array(*listed)))
