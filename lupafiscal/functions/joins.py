"""Joins on a key one of whose values may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join on ``key`` (a column, or some) so that adaptive execution can split a hot key.

    Spark splits a skewed join only where both inputs come straight from a
    shuffle and no later operator relies on how the result is partitioned.
    Inputs already grouped or joined on ``key`` would be reused as they are and
    the hot value would stay in one task.  Joining on the key and on its hash
    asks for a partitioning that no earlier step on ``key`` alone provides, so
    each input gets its own shuffle and later steps do not build on this one.
    A pair of rows matches exactly if it matches on ``key``.
    """
    keys = [key] if isinstance(key, str) else key
    tag = f"_{'_'.join(keys)}_hash"
    left = left.withColumn(tag, F.xxhash64(*keys))
    right = right.withColumn(tag, F.xxhash64(*keys))
    joined = left.join(right, [*keys, tag], how)
    if condition is not None:
        joined = joined.filter(condition)
    return joined.drop(tag)


# Days since 0001-01-01 up to the end of 9999 fit in as many bits.
DAY_BITS = 22


def earlier_later(
    left: DataFrame, right: DataFrame, key: str, earlier: str, later: str, firsts: DataFrame, lasts: DataFrame
) -> DataFrame:
    """Pairs of rows with equal ``key`` and ``earlier`` (left) before ``later`` (right), and no other pairs.

    A condition on the dates would be tested on every pair of a key.  Two days are in
    order exactly if at one bit, the highest in which their numbers differ, the earlier
    has 0 and the later 1.  So each row stands for itself in the dyadic ranges above its
    day: the earlier at its bits of 0, the later at its bits of 1, and a pair meets by
    equality in one range alone.  Ranges in which its own key has no row of the other
    side are dropped before the join by the key's last or first day, so that mostly few
    are left.  Null keys and days, which are in no order, pair with nothing.
    """
    top, tag = f"_{later}_max", f"_{earlier}_min"
    last = right.groupBy(key).agg(F.max(later).alias(top))
    first = left.groupBy(key).agg(F.min(earlier).alias(tag))
    left = spread_join(left, last, key).filter(F.col(earlier) < F.col(top))
    right = spread_join(right, first, key).filter(F.col(later) > F.col(tag))

    def at_bits(rows: DataFrame, day: str, bit: int, other: str) -> DataFrame:
        """The row once for each range it may meet a row of the other side in.

        No range above the highest bit in which its day and the other side's farthest differ can hold a pair.
        """
        def number(name: str) -> Column:
            return F.date_diff(name, F.lit("0001-01-01").cast("date"))

        here, far = number(day), number(other)
        levels = F.filter(
            F.sequence(F.lit(0), F.lit(DAY_BITS - 1)),
            lambda k: (F.call_function("shiftright", here, k).bitwiseAND(1) == bit)
            & (F.call_function("shiftright", here.bitwiseXOR(far), k) > 0),
        )
        exploded = rows.withColumn("_level", F.explode(levels))
        return exploded.withColumn("_range", F.call_function("shiftright", here, F.col("_level") + 1)).drop(other)

    return spread_join(
        at_bits(left, earlier, 0, top), at_bits(right, later, 1, tag), [key, "_level", "_range"]
    ).drop("_level", "_range")


def distinct_keys(rows: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Keys of the side that only has to exist: combined before the shuffle."""
    key = F.col(column)
    return rows.filter(key.isNotNull()).select(key.alias(alias or column)).distinct()


def having(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return rows.join(keys, column, "left_semi")


def lacking(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return rows.join(keys, column, "left_anti")
