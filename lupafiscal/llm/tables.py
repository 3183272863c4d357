"""Reading input tables and writing intermediate ones where all executors reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lupafiscal.session import new_run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: a short lineage that outlives executors."""
    path = new_run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keeping(df: DataFrame, keep: tuple[str, ...], results: str) -> tuple[list[str], list[Column], list[StructField]]:
    """Names, columns (as k0, k1, ...) and fields of what is kept beside an operator's results.

    A kept column that has the name of a result gives way to it.
    """
    names = [c for c in keep if c not in StructType.fromDDL(results).fieldNames()]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    fields = [StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(names)]
    return names, [c.alias(f"k{i}") for i, c in enumerate(quoted)], fields


BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of a few megabytes, as texts can be long.

    Sets the session's batch size, unless it is smaller already.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(key)) > BATCH_BYTES or _bytes(conf.get(key)) <= 0:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    number = setting.strip().lower().rstrip("bkmg")
    unit = setting.strip().lower()[len(number) :][:1] or "b"
    return int(number) << units[unit]
