"""Sketches of days against exact counts, and days that are not read again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import sketches
from quarry.plans.scratch import scratch



def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def articles(spark):
    """40 days with 600 articles each; half of the contents come again the next day."""
    n = F.col("id") % 600
    day = F.floor(F.col("id") / 600).cast("int")
    return spark.range(24_000).select(
        F.expr("timestamp_ntz'2023-12-24 05:00:00'").alias("t"), day.alias("d"), F.md5((day * 300 + n).cast("string")).alias("content_hash"), F.array(F.concat(F.lit("k"), (F.pow(n, 2) % 50).cast("int").cast("string"))).alias("tags")
    ).select(F.timestamp_add("DAY", "d", "t").alias("crawled_at"), "content_hash", "tags")


def exact(articles, days):
    some = articles.where(F.col("crawled_at") >= now() - F.expr(f"interval {days} days"))
    words = some.groupBy(F.col("tags")[0].alias("k")).count().orderBy(F.desc("count"), "k").limit(20)
    return some.select("content_hash").distinct().count(), [tuple(r) for r in words.collect()]


@pytest.mark.parametrize("days", [1, 7, 30, 60])
def test_merged_days(spark, articles, days):
    sketched = sketches.day_sketches(articles)
    contents, words = exact(articles, days)
    row = sketches.uniques(sketched, now(), days).first()
    assert abs(row.unique_articles - contents) <= 3 * sketches.ERROR * contents and row.articles == 600 * min(days + 1, 40)  # the day of the moment itself, too
    assert [(r.keyword, r.frequency) for r in sketches.keywords(sketched, now(), days).collect()] == words


def test_old_days_are_not_read_again(spark, articles):
    at = f"{scratch(spark)}/days"
    before = articles.where("crawled_at < '2024-01-30'")
    sketches.refresh(before, at)
    old = {r.day: (bytes(r.contents), r.articles) for r in sketches.stored(spark, at).collect()}
    sketches.refresh(articles.where("crawled_at >= '2024-01-30'"), at)
    new = {r.day: (bytes(r.contents), r.articles) for r in sketches.stored(spark, at).collect()}
    assert len(new) == 40 and all(new[d] == v for d, v in old.items()) and max(new) == dt.date(2024, 2, 1)
    contents, words = exact(articles, 30)
    assert abs(sketches.uniques(sketches.stored(spark, at), now(), 30).first().unique_articles - contents) <= 3 * sketches.ERROR * contents
    assert [(r.keyword, r.frequency) for r in sketches.keywords(sketches.stored(spark, at), now(), 30).collect()] == words


def test_no_days(spark, articles):
    none = sketches.day_sketches(articles.limit(0))
    assert tuple(sketches.uniques(none, now(), 7).first()) == (7, 0, 0) and sketches.keywords(none, now(), 7).collect() == []
