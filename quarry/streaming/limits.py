"""Limits of requests per domain: presets, a token bucket and limits that follow the responses, in batch and on a stream.

A verdict depends on those before it, so a domain's requests are folded in their order. They stream through a task sorted, and only
the current domain's state is held; on a stream, micro-batches carry it on in a table of a row a domain. Thousandths
and microseconds are whole numbers, so verdicts do not depend on rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import fixed
from quarry.plans.scratch import remove

#: A token, in thousandths of a request and microseconds.
TOKEN = 1_000_000_000
LIMITS = "domain string, rate double, burst int, delay double"
VERDICTS = "event_id long, domain string, granted boolean, tokens long"
BUCKETS = "domain string, tokens long, at long, granted_at long"


def presets(spark: SparkSession) -> DataFrame:
    """Known domains with their limits."""
    return spark.createDataFrame([(d, *v) for d, v in fixed.DOMAIN_LIMITS.items()], LIMITS)


def limited(log: DataFrame, limits: DataFrame) -> DataFrame:
    """``log`` with rate, burst and delay of its domain; defaults where a domain has none. One row a domain in ``limits``."""
    default = dict(zip(("rate", "burst", "delay"), fixed.DEFAULT_LIMIT))
    return log.join(limits.select("domain", *default), "domain", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def _in_order(log: DataFrame) -> DataFrame:
    """``log`` with each domain's rows in one task and in their order. A window asks for that; repartition alone does not hold behind a join
    by the domain, where Spark leaves it out and may still turn the join into a broadcast one, which reads without dealing."""
    numbered = log.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("us", "event_id")))
    return numbered.where("n > 0").drop("n")  # keeps the window, whose number nobody reads


def token_bucket(log: DataFrame, limits: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Verdicts (event_id, domain, granted, tokens) and, with a null event_id, the state of each domain's bucket behind its last request. A bucket
    holds ``burst`` tokens at most and at first, and gains ``rate`` a second; a request is granted if a token is there and the
    last granted one lies ``delay`` seconds back. log: event_id, domain, us (microseconds); before: a state of each domain."""
    spark = log.sparkSession
    before = spark.createDataFrame([], BUCKETS) if before is None else before
    rows = limited(log, limits).join(before.select("domain", F.col("tokens").alias("had"), "at", "granted_at"), "domain", "left")
    rows = rows.select("domain", "us", "event_id", F.round(F.col("rate") * 1000).cast("long").alias("rate"), "burst", F.round(F.col("delay") * 1_000_000).cast("long").alias("delay"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("had", "at", "granted_at")])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, tokens, at, last = None, 0, 0, -1
        for batch in batches:
            out = []
            for d, us, event, rate, burst, delay, had, had_at, granted_at in batch.itertuples(index=False):
                if d != domain:
                    if domain is not None:
                        out.append((None, domain, None, tokens, at, last))
                    domain, tokens, at, last = d, had if had_at >= 0 else burst * TOKEN, had_at if had_at >= 0 else us, granted_at
                tokens = min(burst * TOKEN, tokens + max(us - at, 0) * rate)
                at = max(at, us)
                good = tokens >= TOKEN and (last < 0 or us - last >= delay)
                if good:
                    tokens, last = tokens - TOKEN, us
                out.append((event, domain, good, tokens, at, last))
            yield _frame(out)
        if domain is not None:
            yield _frame([(None, domain, None, tokens, at, last)])

    return _in_order(rows).mapInPandas(fold, f"{VERDICTS}, at long, granted_at long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["event_id", "domain", "granted", "tokens", "at", "granted_at"])
    return out.astype({"event_id": "Int64", "granted": "boolean"})


def step_limit(rate: float, burst: int, delay: float, errors: int, status: int, seconds: float) -> tuple[float, int, float, int]:
    """A domain's limits after one response."""
    if status == 429:
        return max(rate * 0.5, 0.1), max(burst - 1, 1), min(delay * 2, 10.0), errors + 1
    if status >= 500:
        errors += 1
        return (max(rate * 0.8, 0.2), burst, min(delay * 1.5, 5.0), errors) if errors > 5 else (rate, burst, delay, errors)
    if status == 200:
        errors = max(errors - 1, 0)
        if seconds < 1 and errors == 0 and rate < 2:
            return min(rate * 1.1, 2.0), min(burst + 1, 10), max(delay * 0.95, 0.5), errors
    return rate, burst, delay, errors


ADAPTED = f"{LIMITS}, errors int"


def adaptive_rate(log: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Limits of each domain of the log after its last response, from those in ``limits`` or the defaults on. log: event_id, domain, us,
    status_code, response_time; limits may have ``errors``, the count that a domain starts with."""
    limits = log.sparkSession.createDataFrame([], ADAPTED) if limits is None else limits
    rows = limited(log, limits)
    errors = limits.select("domain", "errors") if "errors" in limits.columns else limits.select("domain", F.lit(0).alias("errors"))
    rows = rows.join(errors, "domain", "left").select("domain", "us", "event_id", "status_code", "response_time", "rate", "burst", "delay", F.coalesce("errors", F.lit(0)).alias("errors"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, now = None, (0.0, 0, 0.0, 0)
        for batch in batches:
            done = []
            for d, _, _, status, seconds, *start in batch.itertuples(index=False):
                if d != domain:
                    if domain is not None:
                        done.append((domain, *now))
                    domain, now = d, tuple(start)
                now = step_limit(*now, int(status), float(seconds))
            yield pd.DataFrame(done, columns=["domain", "rate", "burst", "delay", "errors"])
        if domain is not None:
            yield pd.DataFrame([(domain, *now)], columns=["domain", "rate", "burst", "delay", "errors"])

    return _in_order(rows).mapInPandas(fold, ADAPTED)


def _carried(stream: DataFrame, start: DataFrame, step: Callable[[DataFrame, DataFrame, str], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Run ``step`` over the micro-batches of a stream; each gets the table of a row a domain that the one before left and returns the rows of
    the domains it met. Tables are written under the number of their batch, so one that is run again replaces its own."""
    spark = stream.sparkSession
    tables = f"{path}/tables"

    def write(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(start.schema).parquet(f"{tables}/state={number - 1}")
        new = step(batch, old, f"{path}/out/batch={number}")
        old.join(new.select("domain"), "domain", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{tables}/state={number}")
        remove(spark, f"{tables}/state={number - 2}")

    start.write.mode("ignore").parquet(f"{tables}/state=-1")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(T.StructType([*start.schema.fields, T.StructField("state", T.IntegerType())])).parquet(tables)
    last = every.agg(F.max("state")).first()[0]
    return every.where(F.col("state") == (-1 if last is None else last)).drop("state")


def adaptive_rate_stream(stream: DataFrame, path: str, checkpoint: str, limits: DataFrame | None = None) -> DataFrame:
    """``adaptive_rate`` over a stream: the limits behind its last micro-batch."""
    start = stream.sparkSession.createDataFrame([], ADAPTED)
    if limits is not None:
        start = limits.select("domain", "rate", "burst", "delay", F.lit(0).alias("errors"))
    return _carried(stream, start, lambda batch, old, _: adaptive_rate(batch, old), path, checkpoint)


def token_bucket_stream(stream: DataFrame, limits: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``token_bucket`` over a stream: the verdicts of all micro-batches."""
    spark = stream.sparkSession

    def step(batch: DataFrame, old: DataFrame, out: str) -> DataFrame:
        token_bucket(batch, limits, old).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        return done.where("event_id is null").select("domain", "tokens", "at", "granted_at")

    _carried(stream, spark.createDataFrame([], BUCKETS), step, path, checkpoint)
    return spark.read.schema(f"{VERDICTS}, batch int").parquet(f"{path}/out").where("event_id is not null").drop("batch")
