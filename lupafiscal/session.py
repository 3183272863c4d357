"""Session settings the jobs are written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed joins are split and small sides broadcast by their measured size at
# run time; nothing in the library forces a broadcast by hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


TASK_BYTES = 128 << 20
MOST_PARTITIONS = 1 << 16


def sized_for(input_bytes: int, task_bytes: int = TASK_BYTES) -> dict[str, str]:
    """Scan and shuffle settings for the bytes of the largest table's columns that are read.

    Scans and shuffles start with a partition per ``task_bytes``, but never with more than
    ``MOST_PARTITIONS``: beyond 8 TB partitions grow instead, to 1.5 GB at 100 TB, as the
    blocks between tasks are maps times partitions.  Adaptive execution merges small ones.
    """
    share = max(task_bytes, -(-input_bytes // MOST_PARTITIONS))
    partitions = str(max(8, -(-input_bytes // share)))
    return {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": partitions,
        "spark.sql.files.maxPartitionBytes": str(share),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes),
    }


def build(master: str | None = None, app: str = "lupafiscal", input_bytes: int | None = None,
          **extra: str) -> SparkSession:
    """A session with ``SETTINGS``, sized for ``input_bytes`` if given; ``extra`` goes over both."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {} if input_bytes is None else sized_for(input_bytes)
    for key, value in {**SETTINGS, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, as its file system counts them."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def fit(spark: SparkSession, input_bytes: int) -> None:
    """Size a running session for an input."""
    for key, value in sized_for(input_bytes).items():
        spark.conf.set(key, value)


# Stored bytes that a scan task reads at most and that a shuffle partition stands for.  A task's groups
# and sorts take some forty times the stored bytes in memory.
SCAN_BYTES = 16 << 20
SHUFFLE_BYTES = 4 << 20


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", setting.strip().lower()).groups()
    return int(number) << " kmgt".index(unit or " ") * 10


def bound_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Have a running session cut an input finely enough that a task's memory doesn't grow with it.

    Partial aggregates hold the groups of a scan task, and grouping, sorts and windows hold a
    shuffle partition.  Settings that cut more finely already stay as they are.
    """
    for key, most in (("spark.sql.files.maxPartitionBytes", SCAN_BYTES),
                      ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SCAN_BYTES)):
        share = max(most, -(-input_bytes // MOST_PARTITIONS))
        if _bytes(spark.conf.get(key)) > share:
            spark.conf.set(key, f"{share}b")
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_PARTITIONS, -(-input_bytes // SHUFFLE_BYTES))
    if wanted > now:
        spark.conf.set(key, str(wanted))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="lupafiscal-")


def new_run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Spark's setting for the removal of a query's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, for what is read more than once.

    The shuffle files behind them are removed then, and not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, new_run_folder(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
