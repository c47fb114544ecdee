"""Filters, projections, validation, paging and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed, scores


def check_paging(page: int, limit: int) -> int:
    """The offset of a page."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1 and limit between 1 and 100")
    return (page - 1) * limit


def check_search(query: str, threshold: float) -> str:
    if len((query or "").strip()) < 2 or not 0 <= threshold <= 1:
        raise ValueError("a query needs 2 characters and a threshold lies between 0 and 1")
    return query.strip()


def page_of(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page of an ordered table; Spark keeps only offset + limit rows of each partition."""
    return df.orderBy(*order).offset(check_paging(page, limit)).limit(limit)


def articles_filtered(articles: DataFrame, page: int = 1, limit: int = 20, category: str | None = None, language: str | None = None, source_id: str | None = None, min_quality: float | None = None, search: str | None = None) -> DataFrame:
    for name, value in (("category", category), ("language", language), ("source_id", source_id)):
        if value is not None:
            articles = articles.where(F.col(name) == value)
    if min_quality is not None:
        articles = articles.where(F.col("quality_score") >= min_quality)
    if search:
        articles = text_search(articles, search)
    return page_of(articles, [F.desc_nulls_last("crawled_at"), F.asc("id")], page, limit)


def text_search(articles: DataFrame, query: str) -> DataFrame:
    """Articles whose title or content is like ``%query%`` in any case; wildcards of the query are live."""
    return articles.where(F.col("title").ilike(f"%{query}%") | F.col("content").ilike(f"%{query}%"))


def by_id(df: DataFrame, value) -> DataFrame:
    return df.where(F.col("id") == value)


def sources_filtered(sources: DataFrame, page: int = 1, limit: int = 20, active_only: bool = True, category: str | None = None) -> DataFrame:
    if active_only:
        sources = sources.where("is_active")
    if category is not None:
        sources = sources.where(F.col("category") == category)
    return page_of(sources, [F.desc_nulls_first("quality_score"), F.asc("id")], page, limit)


def discovery_filtered(results: DataFrame, min_relevance: float = 0.5, page: int = 1, limit: int = 20) -> DataFrame:
    kept = results.where(F.col("tech_relevance_score") >= min_relevance).select("id", "search_query", "discovered_url", "domain", "title", "relevance_score", "tech_relevance_score", "became_source", "discovered_at")
    return page_of(kept, [F.desc("tech_relevance_score"), F.asc("id")], page, limit)


def tag_or_title_match(articles: DataFrame, query: str) -> DataFrame:
    return articles.where(F.col("title").ilike(f"%{query}%") | F.coalesce(F.exists("tags", lambda t: t.ilike(f"%{query}%")), F.lit(False)))


def content_preview(content: Column) -> Column:
    return F.when(F.length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("..."))).otherwise(content)


def promotable(results: DataFrame, min_score: float = 0.7, limit: int = 50) -> DataFrame:
    kept = results.where((F.col("tech_relevance_score") >= min_score) & ~F.col("became_source") & F.col("is_tech_relevant"))
    return kept.orderBy(F.desc("tech_relevance_score"), "id").limit(limit)


def validate_sources(requests: DataFrame) -> DataFrame:
    """Requests with ``reasons``, why each is refused; empty for one that passes."""
    checks = {
        "name": F.length("name").between(1, 255), "category": F.length("category").between(1, 100), "source_type": F.col("source_type").isin(*fixed.SOURCE_KINDS[:5]),
        "crawl_frequency": F.col("crawl_frequency").between(300, 86400), "url": F.try_parse_url("url", F.lit("PROTOCOL")).isNotNull() & F.try_parse_url("url", F.lit("AUTHORITY")).isNotNull(),
    }
    return requests.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()])))


def valid_candidates(candidates: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    formed = F.try_parse_url("url", F.lit("PROTOCOL")).isNotNull() & F.try_parse_url("url", F.lit("AUTHORITY")).isNotNull()
    return candidates.where(~F.col("domain").isin(*fixed.EXCLUDED_DOMAINS) & formed & scores.any_of(text, fixed.CANDIDATE_WORDS))


def likely_tech(df: DataFrame, domain: str = "domain") -> DataFrame:
    return df.where(scores.any_of(F.lower(domain), fixed.TECH_DOMAIN_WORDS))


def validate_new_sources(sources: DataFrame, reachable: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Sources of the last day that were never crawled, active if they can be reached. reachable: id, ok."""
    new = sources.where((F.col("created_at") >= now - F.expr("interval 24 hours")) & F.col("last_crawled").isNull()).orderBy("created_at", "id").limit(limit)
    return new.join(reachable, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("is_active"))


def update_check_selection(articles: DataFrame, now: Column, per_source: int = 50) -> DataFrame:
    recent = articles.where(F.col("crawled_at") >= now - F.expr("interval 7 days"))
    return top_per_group(recent, ["source_id"], [F.desc("crawled_at"), F.asc("id")], per_source)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def hash_window(hashes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return hashes.where(F.col("first_seen_at") >= now - F.expr(f"interval {days} days"))


def expire_hashes(hashes: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Hashes that stay: seen first in the last days, or duplicated."""
    return hashes.where(~((F.col("first_seen_at") < now - F.expr(f"interval {days} days")) & (F.col("duplicate_count") == 0)))


def unprocessed(articles: DataFrame, limit: int = 1000) -> DataFrame:
    return articles.where(~F.col("is_processed") | F.col("content_embedding").isNull()).orderBy(F.desc("crawled_at"), "id").limit(limit)


def fallback_quality(articles: DataFrame, limit: int = 10, category: str | None = None) -> DataFrame:
    if category is not None:
        articles = articles.where(F.col("category") == category)
    return articles.orderBy(F.desc_nulls_first("quality_score"), "id").limit(limit).withColumn("similarity_score", F.lit(0.5))


def ranked_candidates(scored: DataFrame, limit: int = 100) -> DataFrame:
    return scored.orderBy(F.desc("tech_relevance_score"), "url").limit(limit)
