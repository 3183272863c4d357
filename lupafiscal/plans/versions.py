"""Tables kept in hash buckets, of which a load rewrites the touched ones alone.

A table's rows of one bucket lie in ``name/load=k/bucket=b``.  A load writes its buckets
under its own number and then a manifest that says which load each bucket is read from;
writing the manifest is the commit.  What a load that failed has written is not in any
manifest and is overwritten by the next try.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _children(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath().toString() for status in files.listStatus(folder)] if files.exists(folder) else []

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(file)

    def last(self) -> int:
        """The number of the last load that was committed, 0 if none."""
        found = [path for path in self._children(f"{self.root}/manifest") if self._exists(f"{path}/_SUCCESS")]
        return max((int(path.rsplit("=", 1)[1]) for path in found), default=0)

    def versions(self) -> dict[str, dict[int, int]]:
        """For each table the load that each of its buckets is read from."""
        out: dict[str, dict[int, int]] = {}
        last = self.last()
        if last:
            for row in self.spark.read.parquet(f"{self.root}/manifest/load={last}").collect():  # tables x buckets
                out.setdefault(row.name, {})[row.bucket] = row.version
        return out

    def write(self, name: str, rows: DataFrame, load: int) -> None:
        """Rows, with their ``bucket``; one task or more for each bucket, as Spark balances them."""
        balanced = rows.hint("rebalance", "bucket")
        balanced.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/load={load}")

    def commit(self, load: int, touched: Mapping[str, Iterable[int]]) -> None:
        versions = self.versions()
        for name, buckets in touched.items():
            versions.setdefault(name, {}).update(dict.fromkeys(buckets, load))
        rows = [(name, b, k) for name, of in versions.items() for b, k in of.items()]
        manifest = self.spark.createDataFrame(rows, "name string, bucket int, version int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/load={load}")

    def read(self, name: str, schema: StructType, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current rows and their ``bucket``; only the folders of the wanted buckets are read."""
        current = self.versions().get(name, {})
        wanted = current.keys() if buckets is None else current.keys() & set(buckets)
        fields = [*schema.fields, StructField("bucket", IntegerType())]
        paths = [f"{self.root}/{name}/load={current[b]}/bucket={b}" for b in sorted(wanted)]
        paths = [path for path in paths if self._exists(path)]  # a bucket without rows has no folder
        if not paths:
            return self.spark.createDataFrame([], StructType(fields))
        rows = self.spark.read.schema(StructType(fields)).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select([f.name for f in fields])
