"""Helpers shared by the text operators: safe split points and Arrow plumbing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Two white-space characters in a row, one of them a blank: the split below then needs care.
_ODD = re.compile(r" \s|\s ")

#: Rows and bytes that Spark packs into one Arrow batch for the operators of this subpackage, whichever is reached
#: first. Long documents reach 100 KB and more, so Spark's defaults (10,000 rows, 64 MB) would fill a worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Set the Arrow batch size of the session, which keeps a batch of long documents small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def safe_chunks(text: str) -> list[str]:
    """Cut ``text`` where any byte-level BPE pre-tokenizer cuts too: before a single blank between
    two characters that are not white space. The chunks joined are the text."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    if not _ODD.search(text) and parts[0] and parts[-1] and not parts[0][-1].isspace():
        return [parts[0], *[" " + p for p in parts[1:]]]
    out: list[str] = []
    held = [parts[0]]
    last = parts[0][-1:]
    for p in parts[1:]:
        if p and last and not last.isspace() and not p[0].isspace():
            out.append("".join(held))
            held = [" " + p]
        else:
            held.append(" " + p)
        last = p[-1:] or " "
    out.append("".join(held))
    return out


def list_array(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """A ListArray from flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one whose scan has fewer splits than there are cores (a small file of one row group) is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
