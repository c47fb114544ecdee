"""Aggregates of the dashboard, sources, categories, health and insights. One scan and one conditional
aggregate each; every time-relative one takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores

from .filters import top_per_group


def since(column: str, now: Column, interval: str) -> Column:
    return F.col(column) >= now - F.expr(f"interval {interval}")


def mean(column: str, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)), digits)


def dashboard_counts(articles: DataFrame, now: Column) -> DataFrame:
    today = F.date_trunc("day", now)
    return articles.agg(
        F.count("*").alias("total_articles"), F.count_if(F.col("crawled_at") >= today).alias("articles_today"), F.count_if(since("crawled_at", today, "7 days")).alias("articles_this_week"),
        F.count_if(since("crawled_at", today, "30 days")).alias("articles_this_month"), mean("quality_score").alias("avg_quality_score"),
    )


def top_categories(articles: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    out = articles.where("category is not null").groupBy("category").agg(F.count("*").alias("article_count"), mean("quality_score").alias("avg_quality"), F.count_if(since("crawled_at", now, "7 days")).alias("recent_count"))
    return out.withColumn("growth_rate", scores.growth_rate(F.col("article_count"), F.col("recent_count"))).orderBy(F.desc("article_count"), "category").limit(limit)


def by_source(articles: DataFrame, now: Column) -> DataFrame:
    """Articles aggregated per source before any join, so that the join is one row a source."""
    return articles.groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("articles"), F.avg("quality_score").alias("quality"), F.count_if(since("crawled_at", now, "7 days")).alias("recent"), F.count_if(since("crawled_at", now, "24 hours")).alias("day"),
        F.max("crawled_at").alias("last_crawl"), F.count_distinct("category").alias("categories"),
    )


def source_article_left(sources: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sources.join(by_source(articles, now), "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("articles", "recent", "day", "categories")})


def top_sources(sources: DataFrame, articles: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    j = source_article_left(sources, articles, now)
    out = j.select("name", F.col("url").alias("base_url"), F.col("articles").alias("article_count"), F.round(F.coalesce("quality", F.lit(0.0)), 2).alias("avg_quality"), F.round(F.coalesce("trust_score", F.lit(0.0)), 2).alias("trust_score"), F.col("recent").alias("recent_count"), scores.growth_rate(F.col("articles"), F.col("recent")).alias("growth_rate"))
    return out.orderBy(F.desc("article_count"), "name").limit(limit)


def crawl_success_rate(jobs: DataFrame, now: Column) -> DataFrame:
    recent = jobs.where(since("started_at", now, "24 hours"))
    return recent.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "completed") * 100.0, F.count("*")), F.lit(0.0)), 1).alias("success_rate"))


def quality_distribution(articles: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    level = F.when(q >= 0.8, "high").when(q >= 0.6, "medium").when(q >= 0.4, "low").otherwise("very_low")
    return articles.where(q.isNotNull()).groupBy(level.alias("quality_level")).agg(F.count("*").alias("article_count"))


def daily_trends(articles: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return articles.where(since("crawled_at", now, f"{days} days")).groupBy(F.to_date("crawled_at").alias("date")).agg(F.count("*").alias("article_count"), mean("quality_score").alias("avg_quality"))


def top_keywords(articles: DataFrame, now: Column, days: int = 30, limit: int = 20) -> DataFrame:
    tags = articles.where(since("crawled_at", now, f"{days} days")).select(F.explode("tags").alias("keyword"))
    return tags.groupBy("keyword").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "keyword").limit(limit)


def duplication_stats(articles: DataFrame) -> DataFrame:
    out = articles.agg(F.count("*").alias("total_articles"), F.count_distinct("content_hash").alias("unique_articles"))
    out = out.withColumn("duplicates", F.col("total_articles") - F.col("unique_articles"))
    return out.withColumn("duplication_rate", F.round(F.col("duplicates") * 100.0 / F.greatest("total_articles", F.lit(1)), 2))


def source_performance(sources: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    j = source_article_left(sources, articles, now)
    return j.select(
        F.col("id").alias("source_id"), "name", F.col("url").alias("base_url"), F.round(F.coalesce("trust_score", F.lit(0.0)), 2).alias("trust_score"), F.col("articles").alias("total_articles"), F.round(F.coalesce("quality", F.lit(0.0)), 2).alias("avg_quality"),
        F.col("recent").alias("recent_articles"), F.col("day").alias("today_articles"), "last_crawl", F.col("categories").alias("category_diversity"),
        scores.performance_score(F.col("articles"), F.col("quality"), F.col("recent"), F.col("trust_score")).alias("performance_score"),
    )


def source_daily(articles: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return articles.where(since("crawled_at", now, f"{days} days")).groupBy("source_id", F.to_date("crawled_at").alias("date")).agg(F.count("*").alias("article_count"))


def source_categories(articles: DataFrame) -> DataFrame:
    return articles.where("category is not null").groupBy("source_id", "category").agg(F.count("*").alias("article_count"), mean("quality_score").alias("avg_quality"))


def running_and_active(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Two aggregates of one row each, joined."""
    return sources.agg(F.count_if("is_active").alias("active_sources")).crossJoin(jobs.agg(F.count_if(F.col("status") == "running").alias("running_jobs")))


def system_health(metrics: DataFrame, now: Column) -> DataFrame:
    recent = metrics.where(since("recorded_at", now, "1 hour"))
    each = [F.coalesce(F.avg(F.when(F.col("metric_name") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in ("cpu_usage", "memory_usage", "disk_usage")]
    row = recent.agg(*each, F.count("*").alias("n"))
    score = scores.health_score(F.col("cpu_usage"), F.col("memory_usage"), F.col("disk_usage"), F.col("n"))
    return row.select(F.greatest(score, F.lit(0)).alias("health_score"), scores.health_status(score).alias("status"), *[F.round(m, 1).alias(m) for m in ("cpu_usage", "memory_usage", "disk_usage")])


def underperforming_sources(sources: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    j = source_article_left(sources.where("is_active"), articles, now)
    return j.where((F.col("articles") < 10) | (F.col("quality") < 0.4)).select("name", F.col("articles").alias("article_count"), F.round("quality", 6).alias("avg_quality")).orderBy(F.asc_nulls_last("avg_quality"), "name")


def emerging_categories(articles: DataFrame, now: Column) -> DataFrame:
    recent = F.count_if(since("crawled_at", now, "7 days")).alias("recent_count")
    before = F.count_if(since("crawled_at", now, "30 days") & ~since("crawled_at", now, "7 days")).alias("previous_count")
    out = articles.where("category is not null").groupBy("category").agg(recent, before).where("recent_count > 5 and previous_count > 0")
    growth = (F.col("recent_count") - F.col("previous_count")) * 100.0 / F.col("previous_count")
    return out.withColumn("growth_rate", F.round(growth, 1)).where(growth > 50).orderBy(F.desc("recent_count"), "category")


def crawl_efficiency_alert(jobs: DataFrame, now: Column, least: float = 80.0) -> DataFrame:
    out = jobs.where(since("started_at", now, "24 hours")).agg(F.avg(F.when(F.col("status") == "completed", 100.0).otherwise(0.0)).alias("rate"), F.count("*").alias("total_jobs"))
    return out.where((F.col("total_jobs") > 0) & (F.col("rate") < least)).select(F.round("rate", 1).alias("success_rate"), "total_jobs")


def _payloads(under: DataFrame, emerging: DataFrame, alert: DataFrame) -> DataFrame:
    """(type, title, size, payload): at most one row of each kind; the payload is JSON, an array of examples that are ranked and cut
    before they are collected, or the figures of the alert."""

    def listed(found: DataFrame, order: list[Column], most: int, fields: list[str], kind: str, title: str) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order)).alias("rank")  # over a handful of rows
        best = found.orderBy(*order).limit(most).select(F.struct(rank, F.struct(*fields).alias("example")).alias("e"))
        examples = best.agg(F.to_json(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["example"])).alias("payload"))
        return examples.crossJoin(found.agg(F.count("*").alias("size"))).select(F.lit(kind).alias("type"), F.lit(title).alias("title"), "size", "payload")

    a = listed(under, [F.asc_nulls_last("avg_quality"), F.asc("name")], 5, ["name", "article_count"], "warning", "underperforming sources")
    b = listed(emerging, [F.desc("recent_count"), F.asc("category")], 3, ["category", "recent_count", "previous_count", "growth_rate"], "info", "emerging categories")
    c = alert.select(F.lit("error").alias("type"), F.lit("crawl efficiency").alias("title"), F.col("total_jobs").alias("size"), F.to_json(F.struct("success_rate", "total_jobs")).alias("payload"))
    return a.unionByName(b).unionByName(c).where("size > 0")


def insights(sources: DataFrame, articles: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Sources that fall short, categories that grow and jobs that fail, each with examples."""
    return _payloads(underperforming_sources(sources, articles, now), emerging_categories(articles, now), crawl_efficiency_alert(jobs, now))


def article_figures(articles: DataFrame) -> DataFrame:
    """What insights need of each article, to be summed: (kind, key, hour, n, points), for its category and hour and for its source with
    its quality in hundredths, which are whole and add up the same in any order."""
    category = F.struct(F.lit("category").alias("kind"), F.col("category").alias("key"), F.date_trunc("hour", "crawled_at").cast("timestamp_ntz").alias("hour"), F.lit(0).cast("long").alias("points"))
    source = F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("hour"), F.round(F.col("quality_score") * 100).cast("long").alias("points"))
    return articles.select(F.explode(F.array(category, source)).alias("f")).select("f.kind", "f.key", "f.hour", F.lit(1).cast("long").alias("n"), "f.points")


def job_figures(jobs: DataFrame) -> DataFrame:
    """The same of each job: its hour, and whether it was completed."""
    return jobs.select(F.lit("job").alias("kind"), F.lit(None).cast("string").alias("key"), F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("hour"), F.lit(1).cast("long").alias("n"), (F.col("status") == "completed").cast("long").alias("points"))


def summed(figures: DataFrame) -> DataFrame:
    """Figures of one kind, key and hour as one row; sums may be summed again."""
    return figures.groupBy("kind", "key", "hour").agg(F.sum("n").alias("n"), F.sum("points").alias("points"))


def insights_of_figures(figures: DataFrame, sources: DataFrame, now: Column, least: float = 80.0) -> DataFrame:
    """``insights`` from summed figures alone; ``now`` is a full hour."""
    per = figures.where("kind = 'source'").groupBy(F.col("key").alias("id")).agg(F.sum("n").alias("articles"), F.sum("points").alias("points"))
    j = sources.where("is_active").join(per, "id", "left").withColumn("articles", F.coalesce("articles", F.lit(0).cast("long"))).withColumn("quality", F.col("points") / (100.0 * F.col("articles")))
    under = j.where((F.col("articles") < 10) | (F.col("quality") < 0.4)).select("name", F.col("articles").alias("article_count"), F.round("quality", 6).alias("avg_quality"))
    new, old = since("hour", now, "7 days"), since("hour", now, "30 days")
    found = figures.where("kind = 'category' and key is not null").groupBy(F.col("key").alias("category")).agg(F.sum(F.when(new, F.col("n")).otherwise(0)).alias("recent_count"), F.sum(F.when(old & ~new, F.col("n")).otherwise(0)).alias("previous_count"))
    growth = (F.col("recent_count") - F.col("previous_count")) * 100.0 / F.col("previous_count")
    emerging = found.where("recent_count > 5 and previous_count > 0").withColumn("growth_rate", F.round(growth, 1)).where(growth > 50)
    day = figures.where(F.col("kind") == "job").where(since("hour", now, "24 hours")).agg(F.sum("n").alias("total_jobs"), F.sum("points").alias("completed"))
    rate = F.col("completed") * 100.0 / F.col("total_jobs")
    return _payloads(under, emerging, day.where((F.col("total_jobs") > 0) & (rate < least)).select(F.round(rate, 1).alias("success_rate"), "total_jobs"))


def sources_stats(sources: DataFrame, now: Column) -> DataFrame:
    return sources.agg(F.count("*").alias("total_sources"), F.count_if("is_active").alias("active_sources"), F.count_if(since("last_crawled", now, "24 hours")).alias("crawled_today"), mean("quality_score").alias("avg_quality"), F.count_distinct("category").alias("categories"))


def sources_by_category(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").groupBy("category").agg(F.count("*").alias("source_count"), mean("quality_score").alias("avg_quality"))


def articles_stats(articles: DataFrame, now: Column) -> DataFrame:
    return articles.agg(F.count("*").alias("total_articles"), F.count_if(since("crawled_at", now, "24 hours")).alias("articles_24h"), F.count_if(since("crawled_at", now, "7 days")).alias("articles_7d"), mean("quality_score").alias("avg_quality"), F.count_distinct("language").alias("languages"))


def articles_by_language(articles: DataFrame, limit: int = 10) -> DataFrame:
    return articles.groupBy("language").agg(F.count("*").alias("article_count")).orderBy(F.desc("article_count"), "language").limit(limit)


def hash_stats(hashes: DataFrame) -> DataFrame:
    d = F.col("duplicate_count")
    return hashes.agg(F.count("*").alias("total_hashes"), F.coalesce(F.sum(d), F.lit(0)).alias("total_duplicates"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("avg_duplicates_per_hash"), F.count_if(d > 0).alias("hashes_with_duplicates"))


def successful_queries(results: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    kept = results.where(since("discovered_at", now, "30 days") & F.col("is_tech_relevant"))
    return kept.groupBy("search_query").agg(F.round(F.avg("tech_relevance_score"), 6).alias("avg_score"), F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("avg_score"), "search_query").limit(limit)


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """Ids per url that has several, oldest first; ``redundant`` are all but the oldest."""
    out = sources.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("all")).where(F.size("all") > 1)
    return out.select("url", F.transform("all", lambda x: x["id"]).alias("ids"), F.transform(F.slice("all", 2, F.size("all")), lambda x: x["id"]).alias("redundant"))


def crawl_run_stats(runs: DataFrame, most_errors: int = 5) -> DataFrame:
    """runs: source_id, outcome (new, updated, duplicate, failed), error. ``errors`` are the most frequent distinct ones, at most
    ``most_errors`` a source."""
    o = F.col("outcome")
    counts = runs.groupBy("source_id").agg(F.count("*").alias("crawled"), F.count_if(o != "failed").alias("processed"), *[F.count_if(o == k).alias(k) for k in ("failed", "new", "updated", "duplicate")])
    each = runs.where("error is not null").groupBy("source_id", "error").agg(F.count("*").alias("n"))
    best = top_per_group(each, ["source_id"], [F.desc("n"), F.asc("error")], most_errors)
    said = best.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "error"))).alias("e"))
    said = said.select("source_id", F.transform("e", lambda e: e["error"]).alias("errors"))
    return counts.join(said, "source_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def rate_domain_stats(log: DataFrame, now: Column) -> DataFrame:
    return log.groupBy("domain").agg(F.count_if(since("ts", now, "60 seconds")).alias("recent_requests"), F.count_if(F.col("status_code") != 200).alias("errors"), F.timestamp_diff("SECOND", F.max("ts"), now).alias("last_request_ago"), F.count("*").alias("total_requests"))


def known_domains(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").select("domain").distinct()


def discovery_run_stats(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Per category: candidates explored, valid and new. candidates: category, url, valid."""
    seen = candidates.join(known.select("url", F.lit(True).alias("old")), "url", "left")
    return seen.groupBy("category").agg(F.count("*").alias("explored"), F.count_if("valid").alias("discovered"), F.count_if(F.col("valid") & F.col("old").isNull()).alias("added"))
