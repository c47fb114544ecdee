"""Tables in the folder that the driver and all executors share.

Writing a step and reading it again cuts its lineage: an executor that is lost later costs a reread, not
the step. The folder is ``spark.checkpoint.dir`` of the session; only in local mode, and only where it
is unset, a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Rows of a key beyond which ``join_few`` deals it over many tasks, and over how many.
HOT_ROWS, SALTS = 1000, 256


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quarry-"))
    return _LOCAL[0]


class Tables:
    """Tables of one run of an operator; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{folder(spark)}/quarry-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._quarry_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quarry_path)
            path.getFileSystem(conf).delete(path, True)


def join_few(many: DataFrame, few: DataFrame, keys: list[str], by: str, most_hot: int = 0) -> DataFrame:
    """``many`` left joined to ``few``, which has one row a key with ``copies``, its rows in ``many``. A key of over HOT_ROWS
    rows is dealt over SALTS tasks by the column ``by``; its row of ``few`` is repeated for each, which adds at
    most a quarter to the rows of ``many``. Rows that such a key has taken leave the second join by a key of their own.
    With ``most_hot`` those keys are counted first, and up to that many are broadcast, so ``many`` is dealt once."""
    found = [c for c in few.columns if c not in keys]
    hot = few.where(F.col("copies") > HOT_ROWS).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in found])
    cold = few.where(F.col("copies") <= HOT_ROWS).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], *[F.col(c).alias(f"_cold_{c}") for c in found], F.lit(False).alias("_taken"))
    if most_hot and hot.count() <= most_hot:
        one = many.join(F.broadcast(hot), keys, "left")
    else:
        hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        one = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(hot, [*keys, "_salt"], "left")
    one = one.withColumn("_taken", F.col("_hot_copies").isNotNull()).withColumn("_first", F.when(F.col("_taken"), F.xxhash64(by)).otherwise(F.col(keys[0])))
    same = (F.col("_first") == F.col(f"_cold_{keys[0]}")) & (one["_taken"] == cold["_taken"])
    for k in keys[1:]:
        same &= F.col(k) == F.col(f"_cold_{k}")
    return one.join(cold, same, "left").select(*[many[c] for c in many.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in found])
