"""Structured Streaming twins of the batch operators. Event times are TIMESTAMP (watermarks reject NTZ)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import IntegerType

from quarry.operators.analytics import insights_of_figures, summed
from quarry.operators.discovery import CrawlState, apply_batch, extract_batch
from quarry.plans.buckets import COUNT, Buckets
from quarry.plans.scratch import scratch

def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come in, at most ``files`` in one micro-batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def table_stream(spark: SparkSession, sf: str, name: str, schema) -> DataFrame:
    """A table as a stream, be it a file or a folder of part files. Streams take a single file only by a pattern of paths, which fits both."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def tumbling(stream: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "metric_name").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))
    return w.select(F.col("window.start").alias("start"), "metric_name", "n", F.round("avg_value", 6).alias("avg_value"))


def sliding_rate(stream: DataFrame, width: str = "10 seconds", step: str = "1 second", late: str = "1 minute") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "domain").agg(F.count("*").alias("requests"))
    return w.select(F.col("window.start").alias("start"), "domain", "requests")


def crawl_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "domain").agg(F.count("*").alias("requests"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "domain", "requests")


def dedup(stream: DataFrame, horizon: str = "90 days", key: str = "content_hash") -> DataFrame:
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])


def job_alerts(stream: DataFrame, width: str = "1 day", late: str = "1 day", least: float = 80.0) -> DataFrame:
    """Jobs and completed ones per window; ``alert`` where too few complete. stream: ts, completed."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("total_jobs"), F.count_if("completed").alias("completed"))
    rate = F.col("completed") * 100.0 / F.col("total_jobs")
    return w.select(F.col("window.start").alias("start"), "total_jobs", "completed", F.round(rate, 1).alias("success_rate"), (rate < least).alias("alert"))


def category_windows(stream: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Articles of a category per window, from which growth over the window before is read. stream: ts, category."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "category").agg(F.count("*").alias("articles"))
    return w.select(F.col("window.start").alias("start"), "category", "articles")


def source_windows(stream: DataFrame, width: str = "7 days", late: str = "1 day", few: int = 10, low: float = 0.4) -> DataFrame:
    """Articles and mean quality of a source per window, and whether it falls short. stream: ts, source_id, quality_score."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "source_id").agg(F.count("*").alias("articles"), F.avg("quality_score").alias("quality"))
    return w.select(F.col("window.start").alias("start"), "source_id", "articles", F.round("quality", 6).alias("quality"), ((F.col("articles") < few) | (F.col("quality") < low)).alias("underperforms"))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts a day; rows later than the watermark are dropped and show in the query's progress."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("day"), "n")


REGISTRY = "content_hash string, duplicate_count long, last_seen timestamp, expired boolean"
#: Groups of hashes that share a state; the timer of a hash that stays.
GROUPS, NEVER = 4096, 1 << 62


class _Registry(StatefulProcessor):
    """Duplicates, last and first time of the hashes of a group. A hash without duplicates is forgotten when it is due; the group has one timer, for the first
    that is. A call to the state goes through a socket, so a group's rows are read and written in one piece, and a micro-batch takes a few calls a group, not a hash."""

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows binary, timer long")

    def _load(self) -> tuple[pd.DataFrame | None, int]:
        if not self.seen.exists():
            return None, NEVER
        rows, timer = self.seen.get()
        return pa.ipc.open_stream(rows).read_pandas(), timer

    def _store(self, rows: pd.DataFrame, timer: int) -> None:
        due = int(rows["due"].min()) if len(rows) else NEVER
        if timer not in (NEVER, due):
            self.handle.deleteTimer(timer)
        if due not in (NEVER, timer):
            self.handle.registerTimer(due)
        if not len(rows):
            self.seen.clear()
            return
        sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.seen.update((sink.getvalue().to_pybytes(), due))

    def _due(self, rows: pd.DataFrame, now_ms: int) -> pd.Series:
        first = rows["first"].astype("int64") // 1000 + self.keep_ms
        return first.clip(lower=now_ms + 1).where(rows["n"].eq(0) & rows["first"].notna(), NEVER)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held, timer = self._load()
        rows = pd.DataFrame({"content_hash": initialState["content_hash"], "n": initialState["duplicate_count"].astype("int64")})
        rows = rows.assign(**{c: initialState[f"{c}_seen_at"].astype("datetime64[us]") for c in ("last", "first")})
        rows["due"] = self._due(rows, max(timerValues.getCurrentWatermarkInMs(), 0))
        self._store(rows if held is None else pd.concat([held, rows], ignore_index=True), timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        new = None
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]")
            part = pd.DataFrame({"content_hash": batch["content_hash"], "n": 1, "last": times, "first": times, "due": NEVER})
            new = _merged(part if new is None else pd.concat([new, part], ignore_index=True))
        new["n"] -= 1  # the first of a hash is no duplicate
        kept = held
        if held is not None:
            met = held["content_hash"].isin(new["content_hash"])
            old, kept = held[met], held[~met]
            new = _merged(pd.concat([old.assign(n=old["n"] + 1), new], ignore_index=True))
        new["due"] = self._due(new, timerValues.getCurrentWatermarkInMs())
        self._store(new if kept is None or not len(kept) else pd.concat([kept, new], ignore_index=True), timer)
        yield self._rows(new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        if held is not None:
            over = held["due"] <= timerValues.getCurrentWatermarkInMs()
            self._store(held[~over], timer)
            yield self._rows(held[over], True)

    @staticmethod
    def _rows(rows: pd.DataFrame, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"content_hash": rows["content_hash"], "duplicate_count": rows["n"], "last_seen": rows["last"], "expired": expired})

    def close(self) -> None:
        pass


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a hash; a null one stays None, as it comes back from the state."""
    out = rows.groupby("content_hash", dropna=False, sort=False).agg({"n": "sum", "last": "max", "first": "min", "due": "min"}).reset_index()
    return out.assign(content_hash=out["content_hash"].astype(object).where(out["content_hash"].notna(), None))


def hash_registry(stream: DataFrame, keep_days: int = 90, stored: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Count and last time of each hash; one without duplicates is forgotten ``keep_days`` after it was first seen. The first batch starts
    from ``stored``, a registry of one row a hash. State lies in RocksDB (``rocksdb``), by ``groups`` of hashes, a number that has to stay for a checkpoint: a micro-batch
    rewrites the groups that its hashes fall into."""
    group = F.pmod(F.xxhash64("content_hash"), F.lit(groups)).alias("group")
    initial = None
    if stored is not None:
        initial = stored.select(group, "content_hash", "duplicate_count", F.col("last_seen_at").cast("timestamp").alias("last_seen_at"), F.col("first_seen_at").cast("timestamp").alias("first_seen_at")).groupBy("group")
    rows = stream.select(group, "content_hash", "ts").withWatermark("ts", "1 hour").groupBy("group")
    return rows.transformWithStateInPandas(_Registry(keep_days), REGISTRY, "update", "EventTime", initial)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams that start inside."""
    key, old = "spark.sql.streaming.stateStore.providerClass", None
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def insight_stream(figures: DataFrame, sources: DataFrame, now: Column, path: str, checkpoint: str) -> DataFrame:
    """``insights`` kept over a stream of figures (``article_figures``, ``job_figures`` or both). A micro-batch adds its own sums, a few rows, and
    derives from the sums of all batches the growth against the window before and the payloads; those of each batch stay under
    its number. Returns the last ones."""
    spark = figures.sparkSession
    sums = f"{path}/sums"

    def write(batch: DataFrame, number: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{sums}/batch={number}")
        every = spark.read.schema(figures.schema.add("batch", IntegerType())).parquet(sums).where(F.col("batch") <= number)
        insights_of_figures(summed(every), sources, now).write.mode("overwrite").parquet(f"{path}/insights/batch={number}")

    figures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("type string, title string, size long, payload string, batch int").parquet(f"{path}/insights")
    return found.where(F.col("batch") == spark.read.parquet(sums).agg(F.max("batch")).first()[0]).drop("batch")


class _Dropped(StreamingQueryListener):
    """Rows that the state operators of a query drop as late, from its progress."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()


def late_rows(stream: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """One row (kept, dropped): distinct rows that came in time, and rows that came behind the watermark. Dropped ones are counted by the engine
    in the query's progress, row by row, as duplicates are removed where rows are not aggregated before."""
    spark, kept = stream.sparkSession, {}

    def write(batch: DataFrame, number: int) -> None:
        kept[number] = batch.count()

    listener = _Dropped()
    spark.streams.addListener(listener)
    try:
        rows = stream.withWatermark("ts", late).dropDuplicates([*key, "ts"])
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch(spark)}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.ended.setdefault(str(query.runId), Event()).wait(60)  # events come in order; this is the last one
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(sum(kept.values()), listener.rows.get(str(query.runId), 0))], "kept long, dropped long")


def crawl_ingest(stream: DataFrame, start: CrawlState, now: Column, path: str, checkpoint: str, robots: DataFrame | None = None, buckets: int = COUNT) -> tuple[CrawlState, DataFrame]:
    """The ingest job on a stream of fetched pages. Tables lie in hash buckets of url, content hash and domain; a micro-batch reads and
    writes only those that its pages fall into (``Buckets``), and one that is run again changes nothing. Returns the last tables
    and the run statistics of all batches."""
    spark = stream.sparkSession
    keys = {"articles": "url", "hashes": "content_hash", "sources": "id"}
    held = {name: Buckets(spark, f"{path}/{name}", t.schema, keys[name], buckets) for name, t in start._asdict().items()}

    def write(batch: DataFrame, number: int) -> None:
        done = extract_batch(batch, now, robots)
        of = {"articles": done.select("url"), "hashes": done.where(F.length("content") > 0).select("content_hash"), "sources": done.select("domain")}
        touched = {name: b.touched(of[name]) for name, b in held.items()}
        new, stats = apply_batch(done, CrawlState(*[held[name].read(number - 1, touched[name]) for name in keys]), now)
        for name, t in new._asdict().items():
            held[name].write(number, t, touched[name])
        stats.write.mode("overwrite").parquet(f"{path}/runs/batch={number}")

    for name, t in start._asdict().items():
        held[name].start(t)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = min(b.last() for b in held.values())
    runs = spark.read.parquet(f"{path}/runs") if last >= 0 else spark.createDataFrame([], "source_id string, crawled long, batch int")
    return CrawlState(*[held[name].read(last) for name in keys]), runs
