"""Records of CSV files whose quoted fields hold line breaks, cut out by many tasks.

Whether a line end closes a record depends on all quotes before it in its file.  So each
block of a file (what one task reads) is summed up by the parity of its quotes; the parities
before each block come from a running sum over one row per block; and each block is then cut
at the line ends outside quotes.  Only the pieces at a block's two borders meet those of
other blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with ``odd``: whether a quote opens or closes in them and stays so."""
    quotes = F.length("texto") - F.length(F.replace("texto", F.lit(QUOTE), F.lit("")))
    # Ends are line feeds only: a carriage return may belong to a field.
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("texto"),
    ).withColumn("odd", (quotes % 2).cast("int"))


def _in_block() -> WindowSpec:
    return Window.partitionBy("arquivo", "bloco").orderBy("place")


def _before(lines: DataFrame) -> DataFrame:
    """``p``: parity of the quotes before a line in its block."""
    return lines.withColumn("p", (F.sum("odd").over(_in_block()) - F.col("odd")) % 2)


def block_states(lines: DataFrame) -> DataFrame:
    """Each block's ``inside`` (1 if it begins within quotes) and ``opened``, the block in which
    the record that it begins in has its first line."""
    blocks = _before(lines.select("arquivo", "bloco", "place", "odd")).groupBy("arquivo", "bloco").agg(
        F.sum("odd").alias("odd"), F.max("p").alias("any_odd"))
    earlier = Window.partitionBy("arquivo").orderBy("bloco").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    blocks = blocks.withColumn("inside", inside)
    # The first line of a block has p = 0, so a block that begins outside quotes has a record's first line.
    starts = (F.col("inside") == 0) | (F.col("any_odd") == 1)
    opened = F.last(F.when(starts, F.col("bloco")), ignorenulls=True).over(earlier)
    return blocks.select("arquivo", "bloco", "inside", opened.alias("opened"))


def _joined(pieces: str) -> Column:
    """Texts of the collected pieces, in order, with the line ends between them."""
    return F.array_join(F.transform(F.array_sort(F.col(pieces)), lambda piece: piece["texto"]), "\n")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``arquivo``, ``bloco`` and ``r`` (block of a record's first line, and its number there, from 1)
    and ``texto``, line ends inside quotes included as they are.

    A file that ends within quotes raises.  Empty records are left out, as they are empty
    lines.  Quotes occur around fields and, doubled, inside such fields only.
    """
    lines = _lines(spark, path)
    placed = lines.join(block_states(lines), ["arquivo", "bloco"])
    placed = _before(placed)
    first = ((F.col("p") + F.col("inside")) % 2 == 0).cast("int")
    # Lines before a block's first record (r = 0) go on with a record of an earlier block.
    placed = placed.withColumn("r", F.sum(first).over(_in_block()))
    pieces = placed.groupBy("arquivo", "bloco", "r").agg(
        F.collect_list(F.struct("place", "texto")).alias("lines"), F.sum("odd").alias("odd"),
        F.first("opened").alias("opened"))
    pieces = pieces.select("arquivo", "bloco", "r", "opened", (F.col("odd") % 2).alias("odd"), _joined("lines").alias("texto"))
    # Within a block, a record that closes has as many opening as closing quotes.
    border = (F.col("r") == 0) | (F.col("odd") == 1)
    inner = pieces.filter(~border).select("arquivo", "bloco", "r", "texto")
    home = F.when(F.col("r") == 0, F.col("opened")).otherwise(F.col("bloco"))
    across = pieces.filter(border).groupBy("arquivo", home.alias("bloco")).agg(
        F.max("r").alias("r"), F.collect_list(F.struct(F.col("bloco").alias("from"), "texto")).alias("parts"), F.sum("odd").alias("odd"))
    unclosed = F.raise_error(F.concat("arquivo", F.lit(": ends within quotes")))
    whole = F.when(F.col("odd") % 2 == 1, unclosed).otherwise(_joined("parts"))
    ended = inner.unionByName(across.select("arquivo", "bloco", "r", whole.alias("texto")))
    ended = ended.withColumn("texto", F.regexp_replace("texto", "\r\\z", ""))
    return ended.filter("texto <> ''")
