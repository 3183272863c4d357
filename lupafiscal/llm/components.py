"""Connected components of a graph given as edges, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal.llm.tables import written


# Edges that a task of a round handles.
EDGES_A_TASK = 50_000


def in_tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    """The same rows in no more than ``tasks`` partitions, if given: few rows are not dealt over many tasks."""
    return df if tasks is None or tasks >= _partitions(df) else df.coalesce(tasks)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's least node) for each node of ``edges`` (a, b) that isn't a root.

    Distributed union-find by alternating stars: every node hands its larger
    neighbours, then its smaller ones, to the least node it knows, until nothing
    changes.  Rounds grow with the logarithm of the longest path.  Each round's
    edges are written to the shared folder; no edge reaches the driver.  Nulls and
    loops are left out; an empty graph has no rows.
    """
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        tasks = -(-state.n // EDGES_A_TASK)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = in_tasks(in_tasks(large, tasks).distinct(), tasks)
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        now = written(in_tasks(in_tasks(small, tasks).unionByName(in_tasks(own, tasks)).distinct(), tasks), "edges")
