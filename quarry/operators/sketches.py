"""Trends from a sketch a day: distinct contents and frequent keywords of any number of days without reading their articles again.

A day's row holds a HyperLogLog sketch of content hashes and a sketch of frequent keywords, some kilobytes each. Sketches of days merge
to that of their span. Distinct counts have a relative error of about 0.8 per cent (one standard deviation); frequencies are exact
as long as a span has fewer than three quarters of ITEMS keywords, and else too low by what is left over at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a HyperLogLog sketch, its relative standard deviation, and keywords that a sketch tracks.
REGISTERS, ERROR, ITEMS = 14, 1.04 / 2**7, 10_000


def day_sketches(articles: DataFrame) -> DataFrame:
    """(day, articles, contents, keywords): one row a day."""
    day = F.to_date("crawled_at").alias("day")
    contents = articles.groupBy(day).agg(F.count("*").alias("articles"), F.hll_sketch_agg("content_hash", REGISTERS).alias("contents"))
    words = articles.select(day, F.explode("tags").alias("keyword")).groupBy("day").agg(F.expr(f"approx_top_k_accumulate(keyword, {ITEMS})").alias("keywords"))
    return contents.join(words, "day", "left")


def refresh(articles: DataFrame, path: str) -> None:
    """Write the sketches of the days that ``articles`` holds, whole days, and leave all other days as they are."""
    day_sketches(articles).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _span(days: DataFrame, now: Column, count: int) -> DataFrame:
    """The days that lie in the last ``count`` days before ``now``, which is a midnight, and later ones."""
    return days.where(F.col("day") >= F.date_sub(now.cast("date"), count))


def uniques(days: DataFrame, now: Column, count: int) -> DataFrame:
    """(days, articles, unique_articles): articles of the last days and about how many of them differ."""
    merged = _span(days, now, count).agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"), F.hll_union_agg("contents").alias("s"))
    return merged.select(F.lit(count).alias("days"), "articles", F.coalesce(F.hll_sketch_estimate("s"), F.lit(0)).alias("unique_articles"))


def keywords(days: DataFrame, now: Column, count: int, limit: int = 20) -> DataFrame:
    """(days, keyword, frequency): the most frequent keywords of the last days."""
    merged = _span(days, now, count).where("keywords is not null").groupBy(F.lit(count).alias("days")).agg(F.expr(f"approx_top_k_combine(keywords, {ITEMS})").alias("s"))
    # Ties beyond the limit are settled by keyword, so more than the limit are estimated.
    top = merged.select("days", F.explode(F.expr(f"approx_top_k_estimate(s, {10 * limit})")).alias("e"))
    best = top.select("days", F.col("e.item").alias("keyword"), F.col("e.count").alias("frequency"))
    return best.orderBy(F.desc("frequency"), "keyword").limit(limit)
