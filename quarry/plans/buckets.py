"""A table that changes batch by batch, in hash buckets of its key.

A batch reads and rewrites only the buckets that its keys fall into, so what is written follows the batch and not the table. Which
version of a bucket counts stands in a manifest for each batch, a row a bucket. A batch that is run again starts from the
manifest before it and replaces its own files. Versions that neither the last manifest nor the one before names are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import remove

#: Buckets of a table: some hundred megabytes each are a good size.
COUNT = 64


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, count: int = COUNT):
        self.spark, self.path, self.schema, self.key, self.count = spark, path, schema, key, count

    def bucket(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.count)).cast("int")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _manifest(self, number: int) -> dict[int, int]:
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest/batch={number}").collect()}

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/version={version}/bucket={bucket}"

    def start(self, df: DataFrame) -> None:
        """The table before the first batch, unless it is there."""
        if not self._exists(f"{self.path}/manifest/batch=-1/_SUCCESS"):
            self._put(-1, df, range(self.count), {})

    def touched(self, *keys: DataFrame) -> list[int]:
        """Buckets of the keys, the first column of each table; at most as many as there are."""
        found: set[int] = set()
        for df in keys:
            found.update(r[0] for r in df.select(self.bucket(df.columns[0]).alias("bucket")).distinct().collect())
        return sorted(found)

    def read(self, number: int, buckets: list[int] | None = None) -> DataFrame:
        """The table behind a batch, or some of its buckets."""
        named = self._manifest(number)
        paths = [self._folder(b, v) for b, v in sorted(named.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, number: int, df: DataFrame, buckets: list[int]) -> None:
        """The batch's version of these buckets: all of their rows."""
        self._put(number, df, buckets, self._manifest(number - 1))

    def _put(self, number: int, df: DataFrame, buckets, before: dict[int, int]) -> None:
        rows = df.select([f.name for f in self.schema]).withColumn("bucket", self.bucket())
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/version={number}")
        now = {b: v for b, v in before.items() if b not in set(buckets)} | {b: number for b in buckets if self._exists(self._folder(b, number))}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        if self._exists(f"{self.path}/manifest/batch={number - 2}/_SUCCESS"):  # what the batch before replaced is read no more
            older = self._manifest(number - 2)
            for b, v in older.items():
                if before.get(b) != v:
                    remove(self.spark, self._folder(b, v))
            remove(self.spark, f"{self.path}/manifest/batch={number - 2}")

    def last(self) -> int:
        """The number of the last batch."""
        return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("batch")).first()[0]
