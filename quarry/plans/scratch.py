"""Where streaming jobs keep checkpoints and tables: ``spark.checkpoint.dir``, which the cluster shares; a temporary folder
only in local mode where it is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run_stream(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; the rows that it wrote (in complete mode, the last state)."""
    spark, at, count = stream.sparkSession, scratch(stream.sparkSession), [0]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")
        count[0] = number

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/table/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", IntegerType())).parquet(f"{at}/table")
    return out.where(F.col("batch") == count[0]).drop("batch") if mode == "complete" else out
