"""Sets of integers as bitmaps by range, from Spark's bitmap functions.

A range is 32,768 neighbouring integers, its bitmap 4 KB.  Rows become bitmaps before
they are shuffled, so that a value costs a bit and not a row, and two sets are compared
range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupafiscal.functions.joins import spread_join
from lupafiscal.session import new_run_folder


def by_range(rows: DataFrame, column: str) -> DataFrame:
    """``faixa`` (range) and ``bits`` of the column's values; nulls are in no set."""
    some = rows.filter(F.col(column).isNotNull())
    return some.groupBy(F.bitmap_bucket_number(column).alias("faixa")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def is_set(bits: Column, value: Column) -> Column:
    """Whether a value is in its range's bitmap; not if there is none."""
    at = F.bitmap_bit_position(value)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def missing(rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows (``column`` alone) whose value isn't among the known ones.

    Only ranges in which the rows have more values than the known set are looked at
    again, value by value.  They are written to the shared folder first, so that Spark
    knows how few they are: where all is known, no row is shuffled.
    """
    own, there = by_range(rows, column), by_range(known, known_column)
    both = own.withColumn("conhecidos", F.lit(None).cast("binary")).unionByName(there.withColumn("conhecidos", F.col("bits")))
    ranges = both.groupBy("faixa").agg(F.bitmap_or_agg("bits").alias("todos"), F.bitmap_or_agg("conhecidos").alias("conhecidos"))
    open_ = ranges.filter(F.bitmap_count("todos") > F.bitmap_count("conhecidos")).select("faixa", "conhecidos")
    path = new_run_folder(rows.sparkSession, "ranges")
    open_.write.parquet(path)
    open_ = rows.sparkSession.read.schema(open_.schema).parquet(path)
    placed = rows.filter(F.col(column).isNotNull()).select(column, F.bitmap_bucket_number(column).alias("faixa"))
    return spread_join(placed, open_, "faixa").filter(~is_set(F.col("conhecidos"), F.col(column))).select(column)
