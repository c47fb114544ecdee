"""Composed jobs: scoring of candidates, discovery, crawl batches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed, scores
from quarry.plans.scratch import scratch

from quarry.sources.payloads import robots_allowed

from . import joins, pages, writes
from .analytics import crawl_run_stats
from .filters import valid_candidates


def domain_quality(domains: DataFrame, meta: DataFrame, html: DataFrame) -> DataFrame:
    """(domain, quality_score): mean of reputation, technical and page scores that are known. meta: domain, https_status,
    http_status, headers; html: domain, html (one page a domain)."""
    j = domains.join(meta, "domain", "left").join(html, "domain", "left")
    known = F.col("headers").isNotNull()
    technical = F.when(known, scores.technical_indicators(F.col("https_status"), F.col("http_status"), F.col("headers")))
    page = F.when(known & F.col("html").isNotNull(), scores.page_score(F.col("html"), F.col("https_status"), F.col("http_status")))
    return j.select("domain", F.round(scores.mean_of(scores.domain_reputation(F.col("domain")), technical, page), 6).alias("quality_score"))


def source_reliability(sites: DataFrame) -> DataFrame:
    """(domain, overall): mean of the domain's quality, freshness, author credibility (a constant) and quality of links. sites:
    domain, quality_score, https_status, http_status, last_modified, html. Half a point where the site did not answer."""
    status = F.coalesce("https_status", "http_status")
    fresh = F.when(status.isNull(), 0.5).when(F.col("last_modified").isNotNull(), 0.8).otherwise(0.6)
    good = scores.any_of(F.col("html"), fixed.GOOD_LINKS)
    links = F.when((status == 200) & F.col("html").isNotNull(), F.when(good, 0.8).otherwise(0.6)).otherwise(0.5)
    return sites.select("domain", F.round((F.col("quality_score") + fresh + F.lit(0.7) + links) / 4, 5).alias("overall"))


def score_candidates(candidates: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    out = candidates.withColumn("relevance_score", F.round(scores.relevance_score(text), 6)).withColumn("tech_relevance_score", scores.tech_relevance(F.col("title"), F.col("description"), F.col("domain")))
    if quality is None:
        return out.withColumn("quality_score", scores.domain_reputation(F.col("domain")))
    return out.join(quality, "domain", "left").withColumn("quality_score", F.coalesce("quality_score", F.lit(0.5)))


def discovery_pipeline(results: DataFrame, sources: DataFrame, stored: DataFrame, links: DataFrame | None = None, max_results: int = 100, threshold: float = 0.6) -> DataFrame:
    """Unknown domains, first of each, valid, scored; then the links of good ones, scored too; rows to store. links: page url,
    url, domain, anchor."""
    first = joins.first_per_domain(joins.known_domain_anti(results, sources))
    scored = score_candidates(valid_candidates(first))
    if links is not None:
        good = scored.where(F.col("tech_relevance_score") > threshold).select(F.col("url").alias("page_url"), "search_query")
        more = joins.links_to_sources(links, sources).join(good, "page_url").select(
            F.col("seq").cast("long").alias("seq"), "url", "domain", F.col("anchor").alias("title"), F.lit("").alias("description"), F.lit("links").alias("source_engine"), "search_query")
        new = score_candidates(valid_candidates(joins.first_per_domain(more))).join(scored.select("domain"), "domain", "left_anti")
        scored = scored.unionByName(new)
    return writes.save_discoveries(scored, stored).orderBy(F.desc("tech_relevance_score"), "url").limit(max_results)


class CrawlState(NamedTuple):
    """Tables that a crawl batch reads and renews."""

    articles: DataFrame
    hashes: DataFrame
    sources: DataFrame


def extract_batch(fetched: DataFrame, now: Column, robots: DataFrame | None = None) -> DataFrame:
    """What the pages of a batch hold, as far as robots files allow them, written once to the shared folder: every table that follows
    reads it. fetched: page_id, url, html; robots: domain, robots_txt."""
    spark = fetched.sparkSession
    if robots is not None:
        hosts = fetched.select("page_id", "url", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("domain"))
        fetched = fetched.join(robots_allowed(hosts, robots).select("url").distinct(), "url", "left_semi")
    at = f"{scratch(spark)}/extracted"
    e = pages.extract_pages(fetched)
    e.select("page_id", "url", "domain", "title", "content", scores.content_hash(F.col("content")).alias("content_hash"), "author", F.col("published_at").cast("timestamp_ntz").alias("published_at")).write.parquet(at)
    return spark.read.parquet(at).withColumn("crawled_at", now)


def apply_batch(done: DataFrame, state: CrawlState, now: Column) -> tuple[CrawlState, DataFrame]:
    """The tables behind a batch of extracted pages, and its run statistics. The state has to hold the rows of the batch's urls,
    content hashes and domains; those are what changes. A page without content counts as failed."""
    rows = done.where(F.length("content") > 0)
    first = rows.groupBy("content_hash").agg(F.min("page_id").alias("page_id")).join(state.hashes.select("content_hash"), "content_hash", "left_anti")
    fresh = rows.join(first, ["content_hash", "page_id"], "left_semi")
    merged = writes.upsert_articles(state.articles, fresh, now)
    outcome = fresh.select("page_id", "url").join(merged.select("url", "outcome"), "url").select("page_id", "outcome")
    failed = F.length(F.coalesce("content", F.lit(""))) == 0
    runs = done.select("page_id", F.col("domain").alias("source_id"), failed.alias("failed")).join(outcome, "page_id", "left")
    runs = runs.select("source_id", F.when(F.col("failed"), "failed").otherwise(F.coalesce("outcome", F.lit("duplicate"))).alias("outcome"), F.when(F.col("failed"), F.lit("no content")).alias("error"))
    stats = crawl_run_stats(runs)
    hashes = writes.register_hashes(state.hashes, rows.select("content_hash", F.col("page_id").alias("id"), "crawled_at", "content"))
    ran = writes.update_source_stats(state.sources, stats, now)
    return CrawlState(merged.drop("updated_at", "outcome"), hashes, ran), stats


def crawl_batch(fetched: DataFrame, state: CrawlState, now: Column, robots: DataFrame | None = None) -> tuple[CrawlState, DataFrame]:
    """One ingest job: pages that robots files allow are extracted, known contents and later copies within the batch are
    duplicates, the others are upserted by url; then hashes, run statistics and source statistics follow. Sources are known by
    their domain."""
    return apply_batch(extract_batch(fetched, now, robots), state, now)
