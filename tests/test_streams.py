"""Streams over several files that come in one by one: state goes from batch to batch, late rows are dropped, timers fire."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.operators import analytics, discovery
from quarry.plans.buckets import Buckets
from quarry.plans.scratch import run_stream, scratch
from quarry.sources import domain
from quarry.streaming import limits as requests
from quarry.streaming import streams

SF = "/root/testdata/sf0.001"


def day(n: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def files(spark, parts, schema, every: int = 1):
    """A stream over the parts, one file each, in order."""
    at = scratch(spark)
    for rows in parts:
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(at)
        schema = df.schema
    return streams.file_stream(spark, at, schema, "*.parquet", files=every)


def test_late_rows_are_dropped_and_open_days_held_back(spark):
    parts = [[(1, day(0.2)), (2, day(0.3)), (3, day(3.1))], [(8, day(3.15))], [(4, day(0.4)), (5, day(2.5)), (6, day(3.2))], [(7, day(9.0))]]
    out = run_stream(streams.daily_counts(files(spark, parts, "event_id long, ts timestamp")), "append")
    # Row 4 comes when the watermark (day 2.1) has passed its day, row 5 does not; the last day stays open.
    assert sorted((r.day.day, r.n) for r in out.collect()) == [(1, 2), (3, 1), (4, 3)]


def test_hash_registry_counts_over_batches_and_forgets(spark):
    parts = [[("a", day(0)), ("b", day(0)), ("b", day(0.1))], [("b", day(1)), ("c", day(1))], [("d", day(40))], [("d", day(41))]]
    with streams.rocksdb(spark):
        out = run_stream(streams.hash_registry(files(spark, parts, "content_hash string, ts timestamp"), keep_days=10), "update").collect()
    counts = {}
    for r in out:
        if not r.expired:
            counts[r.content_hash] = max(counts.get(r.content_hash, -1), r.duplicate_count)
    assert counts == {"a": 0, "b": 2, "c": 0, "d": 1}
    assert {r.content_hash for r in out if r.expired} == {"a", "c"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_hash_registry_starts_from_a_table_and_goes_on_after_a_restart(spark):
    """Timers of the stored hashes run, too; a hash that expired is new when it comes again."""
    schema = "content_hash string, ts timestamp"
    stored = spark.createDataFrame([("s", 3, day(-1), day(0)), ("t", 0, day(-2), day(-2)), ("u", 0, day(-1), day(-1))], "content_hash string, duplicate_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    at = scratch(spark)
    source, seen = f"{at}/in", []

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.hash_registry(streams.file_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet", files=1), keep_days=10, stored=stored)
        with streams.rocksdb(spark):
            query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        new = sorted((h, n, e) for h, n, _, e in seen)
        seen.clear()
        return new

    assert arrive([("s", day(1)), ("u", day(1)), ("v", day(1))]) == [("s", 4, False), ("u", 1, False), ("v", 0, False)]
    assert arrive([("v", day(2)), ("w", day(20))]) == [("t", 0, True), ("v", 1, False), ("w", 0, False)]
    assert arrive([("t", day(21)), ("s", day(21))]) == [("s", 5, False), ("t", 0, False)]


def test_hashes_of_one_group_expire_one_by_one(spark):
    """All hashes in one group: each is due on its own, one that came again stays, one that was forgotten is new."""
    parts = [[("a", day(0)), ("b", day(2)), ("b", day(2)), ("c", day(4)), (None, day(4))], [("d", day(11)), ("c", day(11))], [("e", day(13))], [("a", day(13)), (None, day(13)), ("f", day(40))], [("f", day(41))]]
    with streams.rocksdb(spark):
        out = run_stream(streams.hash_registry(files(spark, parts, "content_hash string, ts timestamp"), keep_days=10, groups=1), "update").collect()
    assert sorted((str(r.content_hash), r.duplicate_count, r.expired) for r in out) == sorted([
        ("a", 0, False), ("b", 1, False), ("c", 0, False), ("None", 0, False), ("d", 0, False), ("c", 1, False), ("a", 0, True), ("e", 0, False), ("a", 0, False), ("None", 1, False), ("f", 0, False), ("d", 0, True), ("e", 0, True), ("a", 0, True), ("f", 1, False),
    ])


def test_calls_to_the_state_do_not_grow_with_hashes():
    """Each call goes through a socket: a group of 2,000 hashes takes as many as one of 2."""

    class Handle:
        def __init__(self):
            self.calls, self.held = 0, None

        def __getattr__(self, name):
            def call(*values):
                self.calls += 1
                if name == "get":
                    return self.held
                if name == "update":
                    self.held = values[0]
                return {"exists": self.held is not None, "listTimers": iter([])}.get(name, self)

            return call

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    counts = []
    for size in (2, 2000):
        handle, registry = Handle(), streams._Registry(90)
        registry.init(handle)
        for times in (1, 3):
            batch = pd.DataFrame({"content_hash": [f"h{k}" for k in range(size)] * times, "ts": [day(1)] * size * times})
            (rows,) = registry.handleInputRows((7,), iter([batch]), Timers)
            assert len(rows) == size and set(rows["duplicate_count"]) == {0 if times == 1 else 3}
        counts.append(handle.calls)
    assert counts[0] == counts[1] < 16


def test_rows_behind_the_watermark_are_counted(spark):
    parts = [[(1, day(0.2)), (2, day(3.1)), (2, day(3.1))], [(8, day(3.15))], [(4, day(0.4)), (9, day(1.0)), (5, day(2.5))], [(7, day(9.0)), (7, day(9.0))]]
    assert tuple(streams.late_rows(files(spark, parts, "event_id long, ts timestamp"), ["event_id"]).first()) == (5, 2)
    assert tuple(streams.late_rows(files(spark, parts[:1], "event_id long, ts timestamp"), ["event_id"]).first()) == (2, 0)


def test_sessions_run_on_over_batches(spark):
    parts = [[("x", day(0)), ("y", day(0))], [("x", day(0) + dt.timedelta(minutes=20))], [("x", day(2))]]
    out = run_stream(streams.crawl_sessions(files(spark, parts, "domain string, ts timestamp")), "append").collect()
    assert sorted((r.domain, r.requests, (r.end - r.start).seconds // 60) for r in out) == [("x", 2, 50), ("y", 1, 30)]


def paced(spark):
    log = domain.request_log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    return log.withColumn("us", F.floor(F.unix_micros("ts") / 3600))


def thirds(log):
    return [log.where(c) for c in ("ts < '2024-01-08'", "ts >= '2024-01-08' and ts < '2024-01-20'", "ts >= '2024-01-20'")]


def test_limits_go_on_from_micro_batch_to_micro_batch(spark):
    log, limits, at = paced(spark), catalog._limits(spark, SF), scratch(spark)
    out = requests.adaptive_rate_stream(files(spark, thirds(log), None), f"{at}/tables", f"{at}/checkpoint", limits)
    met = log.select("domain").distinct()
    assert sorted(out.join(met, "domain", "left_semi").collect()) == sorted(requests.adaptive_rate(log, limits).collect())
    assert {r.domain for r in out.join(met, "domain", "left_anti").collect()} == {r.domain for r in requests.presets(spark).collect()}
    again = requests.adaptive_rate_stream(files(spark, thirds(log), None), f"{at}/more", f"{at}/more-checkpoint")
    assert sorted(again.collect()) == sorted(requests.adaptive_rate(log).collect())


def test_buckets_go_on_from_micro_batch_to_micro_batch(spark):
    log, limits, at = paced(spark), catalog._limits(spark, SF), scratch(spark)
    got = requests.token_bucket_stream(files(spark, thirds(log), None), limits, f"{at}/tables", f"{at}/checkpoint")
    want = requests.token_bucket(log, limits).where("event_id is not null").select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("granted").count() > 0 < want.where("not granted").count()


def test_presets_decide(spark):
    """The same requests to a domain of each preset and to any other: two, five and three at once, then one in 2, 0.7 and 1 seconds."""
    rows = [(100 * k + i, d, t) for k, d in enumerate(["github.com", "docker.com", "other.org"]) for i, t in enumerate([0, 700_000, 1_000_000, 1_400_000, 2_000_000, 2_100_000, 60_000_000])]
    log = spark.createDataFrame(rows, "event_id long, domain string, us long").repartition(2)
    got = {}
    for r in requests.token_bucket(log, requests.presets(spark)).where("event_id is not null").orderBy("event_id").collect():
        got.setdefault(r.domain, []).append(r.granted)
    assert got == {
        "github.com": [True, False, False, False, True, False, True], "docker.com": [True, True, False, True, False, True, True], "other.org": [True, False, True, False, True, False, True],
    }


def test_insights_over_batches_equal_those_at_once(spark):
    a, jobs = catalog.S.articles(spark, SF), catalog.S.crawl_jobs(spark, SF).withColumn("started_at", F.col("started_at") + F.expr("interval 9 days"))
    then = domain.as_of("2024-01-10 00:00:00")
    figures = analytics.article_figures(a).unionByName(analytics.job_figures(jobs)).withColumn("part", F.pmod(F.xxhash64("key", "hour", "points"), F.lit(3)))
    parts = [figures.where(F.col("part") == k).drop("part") for k in range(3)]
    for moment in (then, domain.as_of()):
        path = scratch(spark)
        got = streams.insight_stream(files(spark, parts, None), catalog.S.sources(spark, SF), moment, f"{path}/tables", f"{path}/checkpoint")
        assert sorted(got.collect()) == sorted(analytics.insights(catalog.S.sources(spark, SF), a, jobs, moment).collect()) and got.count() >= 2
        assert spark.read.parquet(f"{path}/tables/insights").select("batch").distinct().count() == 3


@pytest.fixture(scope="module")
def pages(spark):
    return domain.raw(spark, SF, "pages").where("page_id < 60")


def test_ingest_of_a_stream_equals_that_of_a_batch(spark, pages):
    again = pages.where("page_id < 10").withColumn("page_id", F.col("page_id") + 1000).withColumn("url", F.concat("url", F.lit("?again")))
    parts = [pages.where("page_id < 20"), pages.where("page_id >= 20 and page_id < 40"), pages.where("page_id >= 40").unionByName(again)]
    start = catalog._start(spark, SF)
    start = start._replace(articles=start.articles.limit(0), hashes=start.hashes.limit(0))
    at = scratch(spark)
    state, runs = streams.crawl_ingest(files(spark, parts, None), start, domain.as_of(), f"{at}/tables", f"{at}/checkpoint", catalog._robots(spark, SF))
    batch, stats = discovery.crawl_batch(pages.unionByName(again), start, domain.as_of(), catalog._robots(spark, SF))
    for name, columns in (("articles", ["url", "content_hash", "title"]), ("hashes", ["content_hash", "first_article_id", "duplicate_count"])):
        a, b = (getattr(s, name).select(*columns).collect() for s in (state, batch))
        assert sorted(a) == sorted(b) and a
    total = [runs.agg(F.sum("crawled"), F.sum("new"), F.sum("duplicate"), F.sum("failed")).first(), stats.agg(F.sum("crawled"), F.sum("new"), F.sum("duplicate"), F.sum("failed")).first()]
    assert total[0] == total[1] and total[0][2] > 0
    assert runs.select("batch").distinct().count() == 3
    ran = {r.id: r.crawl_count for r in state.sources.collect()}
    was = {r.id: r.crawl_count for r in start.sources.collect()}
    seen = {r.source_id: r.n for r in runs.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert {k: ran[k] - was[k] for k in ran} == {k: seen.get(k, 0) for k in ran}


def test_failed_pages_and_known_contents(spark, pages):
    empty = spark.createDataFrame([(5000, "https://empty.example.org/a", "<html><body></body></html>"), (5001, "https://empty.example.org/b", None)], pages.schema)
    start = catalog._start(spark, SF)
    first, _ = discovery.crawl_batch(pages, start, domain.as_of())
    _, stats = discovery.crawl_batch(pages.unionByName(empty), first, domain.as_of())
    rows = {r.source_id: r for r in stats.collect()}
    assert rows["empty.example.org"].failed == 2 and rows["empty.example.org"].errors == ["no content"]
    assert all(r.duplicate == r.crawled for k, r in rows.items() if k != "empty.example.org")


def size_of(path):
    import pathlib

    return sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_a_batch_rewrites_its_buckets_only(spark):
    """Bytes follow the batch, old versions go, and a batch that is run twice changes nothing."""
    at = scratch(spark)
    big = spark.range(40_000).select(F.concat(F.lit("u"), "id").alias("url"), F.md5(F.col("id").cast("string")).alias("value"))
    table = Buckets(spark, f"{at}/t", big.schema, "url", 32)
    table.start(big)
    table.start(big.limit(0))  # it is there already
    whole = size_of(f"{at}/t/version=-1")
    want = {r.url: r.value for r in big.collect()}
    for number in range(4):
        batch = {f"u{7 * number}": f"v{number}", f"new{number}": "x"}
        df = spark.createDataFrame(sorted(batch.items()), big.schema)
        touched = table.touched(df.select("url"))
        assert 1 <= len(touched) <= 2
        for _ in range(1 + (number == 2)):
            old = table.read(number - 1, touched)
            table.write(number, old.join(df, "url", "left_anti").unionByName(df), touched)
        want |= batch
        assert size_of(f"{at}/t/version={number}") < whole / 8
        assert {r.url: r.value for r in table.read(number).collect()} == want
    assert table.last() == 3
    assert size_of(f"{at}/t") < 1.4 * whole


def test_ingest_twice_changes_nothing(spark, pages):
    start, at = catalog._start(spark, SF), scratch(spark)
    parts = [pages.where("page_id < 10"), pages.where("page_id < 10"), pages.where("page_id >= 10 and page_id < 14")]
    source = scratch(spark)
    seen = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = streams.file_stream(spark, source, pages.schema, "*.parquet", files=1)
        state, runs = streams.crawl_ingest(stream, start, domain.as_of(), f"{at}/tables", f"{at}/checkpoint", buckets=16)
        seen.append(sorted((r.url, r.content_hash) for r in state.articles.select("url", "content_hash").collect()))
    assert seen[0] == seen[1] and len(seen[2]) == len(seen[1]) + 4
    assert {r.batch: r.n for r in runs.groupBy("batch").agg(F.sum("duplicate").alias("n")).collect()}[1] == 10
    one, all_ = size_of(f"{at}/tables/articles/version=2"), sum(size_of(f"{at}/tables/articles/version={k}") for k in (-1, 0, 1, 2))
    assert one < all_ / 2


def test_a_domain_stays_in_one_task_where_its_join_is_broadcast_late(spark):
    """Limits turn out small only when they are there: Spark then reads the log without dealing it."""
    log = spark.range(0, 400, 1, 8).select(F.col("id").alias("event_id"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("domain"), (F.col("id") * 300_000).alias("us"), F.lit(429).alias("status_code"), F.lit(0.5).alias("response_time"))
    limits = spark.range(2).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"), F.lit(0.5).alias("rate"), F.lit(2).alias("burst"), F.lit(1.0).alias("delay"))
    want = [sorted(map(str, f(log, limits).collect())) for f in (requests.token_bucket, requests.adaptive_rate)]
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [sorted(map(str, f(log, limits).collect())) for f in (requests.token_bucket, requests.adaptive_rate)]
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got == want and len(got[0]) == 402 and len(got[1]) == 2


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """Documents, pages and events as folders of part files give what they give as single files."""
    for name in ("documents", "pages", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_category_windows", "stream_source_windows", "stream_insights", "stream_tumbling_metrics", "stream_ingest"):
        want = sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
        assert want and sorted(map(str, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == want
