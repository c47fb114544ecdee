"""Incremental upserts: each returns the new state of a table from the old one and a batch. A parquet table has
no MERGE, so a state is written to a new place and never over what is being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores

from .filters import promotable, top_per_group, validate_sources
from .joins import new_discoveries_anti, new_sources_anti


def upsert_articles(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """By url: equal hash keeps the row, another updates it, an unknown url is added. The batch's latest row of a url
    counts. Columns: url, title, content, content_hash, author, published_at, crawled_at."""
    fields = ["title", "content", "content_hash", "author", "published_at", "crawled_at"]
    new = top_per_group(batch, ["url"], [F.desc("crawled_at"), F.desc("content_hash")], 1).select("url", *[F.col(c).alias(f"n_{c}") for c in fields])
    j = stored.select("url", *fields).join(new, "url", "full_outer")
    change = F.col("n_content_hash").isNotNull() & (F.col("content_hash").isNull() | (F.col("n_content_hash") != F.col("content_hash")))
    outcome = F.when(F.col("n_content_hash").isNull(), "kept").when(F.col("content_hash").isNull(), "new").when(change, "updated").otherwise("unchanged")
    return j.select("url", *[F.when(change, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.when(change, now).alias("updated_at"), outcome.alias("outcome"))


def register_hashes(hashes: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts and times of hashes after a batch of (content_hash, id, crawled_at, content)."""
    new = batch.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.min_by("id", F.struct("crawled_at", "id")).alias("n_first"), F.min("crawled_at").alias("n_seen"), F.max("crawled_at").alias("n_last"), F.max(F.length("content")).cast("long").alias("n_length")
    )
    j = hashes.join(new, "content_hash", "full_outer")
    count = F.when(F.col("duplicate_count").isNull(), F.col("n") - 1).otherwise(F.col("duplicate_count") + F.coalesce("n", F.lit(0)))
    return j.select(
        "content_hash", F.coalesce("first_article_id", "n_first").alias("first_article_id"), count.alias("duplicate_count"), F.coalesce("first_seen_at", "n_seen").alias("first_seen_at"),
        F.greatest("last_seen_at", "n_last").alias("last_seen_at"), F.coalesce("content_length", "n_length").alias("content_length"),
    )


def save_discoveries(found: DataFrame, stored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows to add: one for each (search_query, url) not stored yet."""
    once = top_per_group(found, ["search_query", "url"], [F.asc("seq")], 1)
    return new_discoveries_anti(once, stored).withColumn("is_tech_relevant", F.col("tech_relevance_score") >= threshold)


def promote_discoveries(results: DataFrame, min_score: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """New sources from the best discoveries, and the discoveries with these marked."""
    best = promotable(results, min_score)
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("domain"))
    host = F.lower(F.try_parse_url("discovered_url", F.lit("AUTHORITY")))
    new = best.select(name.alias("name"), F.col("discovered_url").alias("url"), "domain", scores.source_type(host).alias("source_type"), scores.detect_category(F.col("title"), F.col("description")).alias("category"), "quality_score", F.col("tech_relevance_score").alias("relevance_score"))
    marked = results.join(best.select("id", F.lit(True).alias("_now")), "id", "left").withColumn("became_source", F.col("became_source") | F.coalesce("_now", F.lit(False))).drop("_now")
    return new, marked


def update_source_stats(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """runs: source_id, failed. A source that ran counts one more crawl and its failures."""
    ran = runs.select(F.col("source_id").alias("id"), "failed")
    j = sources.join(ran, "id", "left")
    did = F.col("failed").isNotNull()
    return j.select("id", F.when(did, now).otherwise(F.col("last_crawled")).alias("last_crawled"), (F.col("crawl_count") + did.cast("long")).alias("crawl_count"), (F.col("error_count") + F.coalesce("failed", F.lit(0))).alias("error_count"))


def toggle_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    j = sources.join(ids.select("id", F.lit(True).alias("_flip")).distinct(), "id", "left")
    return j.withColumn("is_active", F.when(F.col("_flip").isNotNull(), ~F.col("is_active")).otherwise(F.col("is_active"))).drop("_flip")


def create_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows to add for valid requests whose url is no source yet; one for each url."""
    fine = validate_sources(requests).where(F.size("reasons") == 0)
    new = new_sources_anti(fine, sources).where(~F.col("conflict"))
    once = top_per_group(new, ["url"], [F.asc("name")], 1)
    return once.select("name", "url", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("domain"), "category", "source_type", F.coalesce("crawl_frequency", F.lit(3600)).alias("crawl_frequency"))


def embed_articles(articles: DataFrame, now: Column, embedder=scores.hash_embedding) -> DataFrame:
    """Content and title vectors by a Column function, or a pandas UDF in its place."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return articles.withColumns({"content_embedding": embedder(both), "title_embedding": embedder(F.coalesce("title", F.lit(""))), "is_processed": F.lit(True), "processed_at": now})
