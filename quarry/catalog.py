"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed, scores
from quarry.functions import language as N
from quarry.operators import analytics as A
from quarry.operators import discovery as D
from quarry.operators import filters as K
from quarry.operators import joins as J
from quarry.operators import pages as H
from quarry.operators import similarity as M
from quarry.operators import sketches as K_
from quarry.operators import vectors as V
from quarry.operators import writes as I
from quarry.plans.scratch import run_stream, scratch
from quarry.sources import domain as S
from quarry.sources import payloads as P
from quarry.sources.domain import NOW
from quarry.streaming import limits as L
from quarry.streaming import streams as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PRELUDE = S.prelude()


def query(name: str, sql: str | None = None, prelude: str = PRELUDE):
    """Register a query, with SQL over the same tables where SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = prelude + sql
        return f

    return add


def now():
    return S.as_of()


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# -- scans ------------------------------------------------------------------------------------------

for _name, _columns in {
    "articles": "id, source_id, url, title, content_hash, language, category, author, published_at, crawled_at, quality_score", "sources": "id, domain, url, source_type, category, is_active, trust_score, quality_score, created_at, last_crawled",
    "crawl_jobs": "id, source_id, status, started_at", "system_metrics": "id, metric_name, value, recorded_at", "discovery_results": "id, search_query, discovered_url, domain, title, tech_relevance_score, is_tech_relevant, discovered_at",
    "content_hashes": "content_hash, first_article_id, duplicate_count, first_seen_at, last_seen_at, content_length",
}.items():
    query(f"scan_{_name}", f"SELECT {_columns} FROM {_name}")(lambda spark, sf, n=_name, c=_columns: getattr(S, n)(spark, sf).select(*c.split(", ")))


#: Pages from which one payload, sitemap or feed is made, at most.
_PAGES = 500


def _payloads(spark, sf, engine: str) -> DataFrame:
    """Search payloads, built from the pages that a query found: one for each query and run of page numbers."""
    c = S.candidates(spark, sf).withColumn("search_query", F.concat_ws("-", "search_query", F.floor(F.col("seq") / _PAGES)))
    items = {"google": F.struct(F.col("url").alias("link"), "title", F.col("description").alias("snippet")), "bing": F.struct("url", F.col("title").alias("name"), F.col("description").alias("snippet")), "duckduckgo": F.struct(F.col("url").alias("FirstURL"), F.concat_ws(" - ", "title", "domain").alias("Text"))}[engine]
    rows = c.groupBy("search_query").agg(F.array_sort(F.collect_list(F.struct("seq", items.alias("item")))).alias("l"), F.min("url").alias("u")).select(F.col("search_query").alias("query"), F.transform("l", lambda x: x["item"]).alias("items"), "u")
    body = {"google": F.struct("items"), "bing": F.struct(F.struct(F.col("items").alias("value")).alias("webPages")), "duckduckgo": F.struct(F.concat(F.lit("about "), "query").alias("Abstract"), F.col("u").alias("AbstractURL"), F.col("query").alias("Heading"), F.col("items").alias("RelatedTopics"))}[engine]
    return rows.select("query", F.lit(engine).alias("engine"), F.to_json(body).alias("payload"))


_BLOCKS = f", blocks AS (SELECT * REPLACE (search_query || '-' || (seq // {_PAGES}) AS search_query) FROM candidates) "

for _name, _engine in (("parse_google_results", "google"), ("parse_bing_results", "bing")):
    query(_name, _BLOCKS + "SELECT search_query AS query, (row_number() OVER (PARTITION BY search_query ORDER BY seq) - 1)::INT AS rank, url, title, description FROM blocks")(
        lambda spark, sf, e=_engine: P.parse_search(_payloads(spark, sf, e), e).drop("source_engine")
    )


@query("parse_ddg_results", _BLOCKS + """, t AS (SELECT search_query AS query, (row_number() OVER (PARTITION BY search_query ORDER BY seq))::INT AS rank, url, CASE WHEN title = '' THEN domain ELSE split_part(title || ' - ' || domain, ' - ', 1) END AS title, title || ' - ' || domain AS description FROM blocks)
SELECT * FROM (SELECT search_query AS query, 0 AS rank, min(url) AS url, search_query AS title, 'about ' || search_query AS description FROM blocks GROUP BY search_query UNION ALL SELECT * FROM t) WHERE rank < 10""")
def _(spark, sf):
    return P.parse_search(_payloads(spark, sf, "duckduckgo"), "duckduckgo").drop("source_engine")


def _xml(spark, sf, start: str, one: str, end: str) -> DataFrame:
    """XML documents for each host from its page urls, one for each run of page numbers; hosts of an odd name length get such
    that are cut off."""
    pages = S.page_hosts(spark, sf).groupBy("domain", F.floor(F.col("page_id") / _PAGES).alias("part"))
    h = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.format_string(one, F.replace(u, F.lit("&"), F.lit("&amp;")))), "").alias("body"))
    return h.select(F.col("domain").alias("source_id"), F.concat(F.lit(start), "body", F.when(F.length("domain") % 2 == 0, F.lit(end)).otherwise(F.lit(""))).alias("xml"))


_HOSTS = "(SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain FROM pages)"
_LISTED = f"SELECT domain AS source_id, (row_number() OVER (PARTITION BY domain, page_id // {_PAGES} ORDER BY url) - 1)::INT AS seq, url FROM {_HOSTS} WHERE length(domain) % 2 = 0"
query("parse_sitemaps", _LISTED)(lambda spark, sf: P.parse_sitemaps(_xml(spark, sf, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "<url><loc>%s</loc></url>", "</urlset>")))
query("parse_feeds", _LISTED)(lambda spark, sf: P.parse_feeds(_xml(spark, sf, "<rss><channel>", "<item><link>%s</link></item>", "</channel></rss>")))


def _linked(spark, sf) -> DataFrame:
    """Pages with two links to other sites behind their own."""
    more = F.format_string('<a href="https://dev%d.example.io/p?a=1&amp;b=2">Other &amp; site</a><a href="//www.plain%d.example.io/q">Plain</a>', F.col("page_id") % 7, F.col("page_id") % 5)
    return S.raw(spark, sf, "pages").withColumn("html", F.concat("html", more))


def _page_links(spark, sf) -> DataFrame:
    return P.page_links(_linked(spark, sf))


_OWN = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"
_WORDS = "regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)"
_TEXT = "regexp_replace(replace({0}, '&amp;', '&'), '^\\s+|\\s+$', '', 'g')"
_LINKS = f""", h AS (SELECT *, {_OWN} AS hrefs, {_WORDS} AS words FROM {_HOSTS}),
own AS (SELECT page_id, unnest(range(0, len(hrefs)))::INT AS seq, regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(unnest(hrefs), '&amp;', '&') AS url, domain, domain AS base_domain, substring({_TEXT.format('unnest(words)')}, 1, 100) AS anchor FROM h),
links AS (SELECT * FROM own UNION ALL SELECT page_id, len(hrefs)::INT, 'https://dev' || page_id % 7 || '.example.io/p?a=1&b=2', 'dev' || page_id % 7 || '.example.io', domain, 'Other & site' FROM h)"""
_LINK_COLUMNS = ["page_id", "seq", "url", "domain", "base_domain", "anchor"]
query("page_internal_links", _LINKS + " SELECT page_id, url, min(seq)::INT AS seq FROM links WHERE domain = base_domain GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(seq)) <= 50")(lambda spark, sf: P.internal_links(_page_links(spark, sf), 50).select("page_id", "url", "seq"))
query("page_external_links", _LINKS + " SELECT * FROM links WHERE domain <> base_domain")(lambda spark, sf: P.external_links(_page_links(spark, sf)).select(*_LINK_COLUMNS))
query("links_to_sources", _LINKS + f" SELECT * FROM links WHERE domain <> base_domain AND {S.sql_any('domain', fixed.TECH_DOMAIN_WORDS)} AND domain NOT IN (SELECT domain FROM sources)")(lambda spark, sf: J.links_to_sources(P.external_links(_page_links(spark, sf)), S.sources(spark, sf)).select(*_LINK_COLUMNS))
query("first_n_links", _LINKS + " SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) <= 5")(lambda spark, sf: K.top_per_group(_page_links(spark, sf), ["page_id"], [F.asc("seq")], 5).select(*_LINK_COLUMNS))
query("extract_pages")(lambda spark, sf: H.extract_pages(S.spread(S.raw(spark, sf, "pages"))))
for _kind in H.EXTRACTORS:
    query(f"extract_{_kind}")(lambda spark, sf, k=_kind: H.extract_pages(S.raw(spark, sf, "pages"), kind=k))
query("clean_element")(lambda spark, sf: H.clean_elements(S.raw(spark, sf, "pages")))
query("page_type")(lambda spark, sf: H.extract_pages(S.raw(spark, sf, "pages")).select("page_id", "content_type"))


@query("robots_allowed", f"SELECT url, domain FROM {_HOSTS} WHERE NOT (length(domain) % 2 = 0 AND regexp_matches(url, '^[a-z]+://[^/?#]+/fr/'))")
def _(spark, sf):
    hosts = S.page_hosts(spark, sf)
    robots = hosts.select("domain").distinct().where(F.length("domain") % 2 == 0).withColumn("robots_txt", F.lit("User-agent: *\nDisallow: /fr/\n"))
    return P.robots_allowed(hosts, robots)


@query("export_table", "SELECT id, url, language, category, crawled_at::DATE AS day FROM articles")
def _(spark, sf):
    """Written as JSON and read again."""
    at = scratch(spark)
    out = S.articles(spark, sf).select("id", "url", "language", "category", F.to_date("crawled_at").alias("day"))
    P.export_table(out, at, "json")
    return spark.read.schema(out.schema).json(at)


@query("export_range", "SELECT id, url, crawled_at::DATE AS day FROM articles WHERE crawled_at >= '2024-01-05' AND crawled_at < '2024-01-12'")
def _(spark, sf):
    """A week, written as CSV and read again."""
    at = scratch(spark)
    out = S.articles(spark, sf).select("id", "url", F.to_date("crawled_at").alias("day"), "crawled_at")
    P.export_table(out, at, "csv", since="2024-01-05", until="2024-01-12", drop=["crawled_at"])
    return spark.read.schema(out.drop("crawled_at").schema).csv(at, header=True)


# -- filters ----------------------------------------------------------------------------------------

_ART = "id, url, title, category, quality_score, crawled_at"
query("articles_filtered", f"SELECT {_ART} FROM articles WHERE language = 'en' AND quality_score >= 0.6 ORDER BY crawled_at DESC, id LIMIT 20 OFFSET 20")(lambda spark, sf: K.articles_filtered(S.articles(spark, sf), page=2, language="en", min_quality=0.6).select(*_ART.split(", ")))
query("articles_text_search", "SELECT id FROM articles WHERE title ILIKE '%the%' OR content ILIKE '%license%'  OR content ILIKE '%the%'")(lambda spark, sf: K.text_search(S.articles(spark, sf), "the").select("id").unionByName(K.text_search(S.articles(spark, sf), "license").select("id")).distinct())
query("article_by_id", "SELECT id, url FROM articles WHERE id = 42")(lambda spark, sf: K.by_id(S.articles(spark, sf), 42).select("id", "url"))
query("sources_filtered", "SELECT id, quality_score FROM sources WHERE is_active ORDER BY quality_score DESC NULLS FIRST, id LIMIT 20")(lambda spark, sf: K.sources_filtered(S.sources(spark, sf)).select("id", "quality_score"))
query("source_by_id", "SELECT id, domain FROM sources WHERE id = 'src3'")(lambda spark, sf: K.by_id(S.sources(spark, sf), "src3").select("id", "domain"))
query("discovery_results_filtered", "SELECT id, search_query, discovered_url, domain, title, round(relevance_score, 6) AS relevance_score, tech_relevance_score, became_source, discovered_at FROM discovery_results WHERE tech_relevance_score >= 0.5 ORDER BY tech_relevance_score DESC, id LIMIT 20")(
    lambda spark, sf: K.discovery_filtered(S.discovery_results(spark, sf)).withColumn("relevance_score", F.round("relevance_score", 6))
)
query("tag_or_title_match", "SELECT id FROM articles WHERE title ILIKE '%src1%' OR len(list_filter(tags, lambda t: t ILIKE '%src1%')) > 0")(lambda spark, sf: K.tag_or_title_match(S.articles(spark, sf), "src1").select("id"))
query("content_preview", "SELECT id, CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS preview FROM articles")(lambda spark, sf: S.articles(spark, sf).select("id", K.content_preview(F.col("content")).alias("preview")))
query("promotable_discoveries", "SELECT id, tech_relevance_score FROM discovery_results WHERE tech_relevance_score >= 0.7 AND NOT became_source AND is_tech_relevant ORDER BY tech_relevance_score DESC, id LIMIT 50")(lambda spark, sf: K.promotable(S.discovery_results(spark, sf)).select("id", "tech_relevance_score"))
_REQ = "SELECT 'n' || seq AS name, url, CASE WHEN seq % 5 = 0 THEN '' ELSE 'tech' END AS category, CASE WHEN seq % 7 = 0 THEN 'magazine' ELSE 'blog' END AS source_type, (seq * 100)::INT AS crawl_frequency, seq FROM candidates"


def _requests(spark, sf):
    c = S.candidates(spark, sf)
    n = F.col("seq")
    return c.select(F.concat(F.lit("n"), n.cast("string")).alias("name"), "url", F.when(n % 5 == 0, "").otherwise("tech").alias("category"), F.when(n % 7 == 0, "magazine").otherwise("blog").alias("source_type"), (n * 100).cast("int").alias("crawl_frequency"), "seq")


_REASONS = f", q AS ({_REQ}), v AS (SELECT *, list_filter([CASE WHEN length(name) NOT BETWEEN 1 AND 255 THEN 'name' END, CASE WHEN length(category) NOT BETWEEN 1 AND 100 THEN 'category' END, CASE WHEN source_type NOT IN ('website', 'blog', 'news', 'docs', 'forum') THEN 'source_type' END, CASE WHEN crawl_frequency NOT BETWEEN 300 AND 86400 THEN 'crawl_frequency' END], lambda x: x IS NOT NULL) AS reasons FROM q)"
query("validate_source_requests", _REASONS + " SELECT seq, array_to_string(reasons, ',') AS reasons FROM v")(lambda spark, sf: K.validate_sources(_requests(spark, sf)).select("seq", F.array_join("reasons", ",").alias("reasons")))
_VALID = f"domain NOT IN ({', '.join(map(S._q, fixed.EXCLUDED_DOMAINS))}) AND {S.sql_any('lower(title || chr(32) || description)', fixed.CANDIDATE_WORDS)}"
query("valid_candidates", f"SELECT seq FROM candidates WHERE {_VALID}")(lambda spark, sf: K.valid_candidates(S.candidates(spark, sf)).select("seq"))
query("validate_new_sources", f"SELECT id, ok AS is_active FROM (SELECT id, created_at FROM sources WHERE created_at >= {NOW} - INTERVAL 20 DAY - INTERVAL 24 HOUR AND last_crawled IS NULL ORDER BY created_at, id LIMIT 50) JOIN (SELECT id, https_status IS NOT NULL OR http_status IS NOT NULL AS ok FROM response_meta) USING (id)")(
    lambda spark, sf: K.validate_new_sources(S.sources(spark, sf), S.response_meta(spark, sf).select("id", (F.col("https_status").isNotNull() | F.col("http_status").isNotNull()).alias("ok")), now() - F.expr("interval 20 days"))
)
query("update_check_selection", f"SELECT id, source_id FROM articles WHERE crawled_at >= {NOW} - INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY crawled_at DESC, id) <= 50")(lambda spark, sf: K.update_check_selection(S.articles(spark, sf), now()).select("id", "source_id"))
query("hash_window", f"SELECT content_hash FROM content_hashes WHERE first_seen_at >= {NOW} - INTERVAL 10 DAY")(lambda spark, sf: K.hash_window(S.content_hashes(spark, sf), now(), 10).select("content_hash"))
query("expired_hashes", f"SELECT content_hash FROM content_hashes WHERE NOT (first_seen_at < {NOW} - INTERVAL 10 DAY AND duplicate_count = 0)")(lambda spark, sf: K.expire_hashes(S.content_hashes(spark, sf), now(), 10).select("content_hash"))
query("likely_tech_domains", f"SELECT id FROM sources WHERE {S.sql_any('lower(domain)', fixed.TECH_DOMAIN_WORDS)}")(lambda spark, sf: K.likely_tech(S.sources(spark, sf)).select("id"))
query("unprocessed_articles", "SELECT id FROM articles_emb WHERE id % 3 <> 0 OR content_embedding IS NULL ORDER BY crawled_at DESC, id LIMIT 1000")(lambda spark, sf: K.unprocessed(S.articles_emb(spark, sf).withColumn("is_processed", F.col("id") % 3 == 0)).select("id"))


@query("api_search_params", "SELECT id FROM articles WHERE title ILIKE '%of%' OR content ILIKE '%of%' ORDER BY crawled_at DESC, id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return K.articles_filtered(S.articles(spark, sf), page=3, limit=20, search=K.check_search("  of ", 0.7)).select("id")


query("paged_articles", "SELECT id FROM articles ORDER BY crawled_at DESC, id LIMIT 50 OFFSET 50")(lambda spark, sf: K.page_of(S.articles(spark, sf), [F.desc("crawled_at"), F.asc("id")], 2, 50).select("id"))
query("fallback_quality_search", "SELECT id, quality_score, 0.5::DOUBLE AS similarity_score FROM articles ORDER BY quality_score DESC NULLS FIRST, id LIMIT 10")(lambda spark, sf: K.fallback_quality(S.articles(spark, sf)).select("id", "quality_score", "similarity_score"))
query("top_k_per_group", "SELECT id, source_id FROM articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY quality_score DESC, id) <= 3")(lambda spark, sf: K.top_per_group(S.articles(spark, sf), ["source_id"], [F.desc("quality_score"), F.asc("id")], 3).select("id", "source_id"))

# -- joins ------------------------------------------------------------------------------------------

_PER = f"per AS (SELECT source_id AS id, count(*) AS articles, avg(quality_score) AS quality, count(*) FILTER (crawled_at >= {NOW} - INTERVAL 7 DAY) AS recent, count(*) FILTER (crawled_at >= {NOW} - INTERVAL 24 HOUR) AS day, max(crawled_at) AS last_crawl, count(DISTINCT category) AS categories FROM articles GROUP BY source_id), sa AS (SELECT s.*, coalesce(articles, 0) AS articles, quality, coalesce(recent, 0) AS recent, coalesce(day, 0) AS day, last_crawl, coalesce(categories, 0) AS categories FROM sources s LEFT JOIN per USING (id))"
query("source_article_left", f", {_PER} SELECT id, articles, round(quality, 6) AS quality, recent, day, last_crawl, categories FROM sa")(lambda spark, sf: J_select(A.source_article_left(S.sources(spark, sf), S.articles(spark, sf), now())))


def J_select(df: DataFrame) -> DataFrame:
    return df.select("id", "articles", r("quality"), "recent", "day", "last_crawl", "categories")


query("duplicate_domains", "SELECT domain, count(*) AS hash_count, sum(duplicate_count)::BIGINT AS duplicate_count FROM content_hashes h JOIN articles a ON h.first_article_id = a.id JOIN sources s ON a.source_id = s.id GROUP BY domain ORDER BY duplicate_count DESC, domain LIMIT 10")(lambda spark, sf: J.duplicate_domains(S.content_hashes(spark, sf), S.articles(spark, sf), S.sources(spark, sf)))
query("known_domain_anti", "SELECT seq FROM candidates WHERE domain NOT IN (SELECT domain FROM sources WHERE is_active)")(lambda spark, sf: J.known_domain_anti(S.candidates(spark, sf), S.sources(spark, sf)).select("seq"))
query("new_discoveries_anti", "SELECT seq FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM discovery_results d WHERE d.id % 2 = 0 AND d.search_query = c.search_query AND d.discovered_url = c.url)")(lambda spark, sf: J.new_discoveries_anti(S.candidates(spark, sf), S.discovery_results(spark, sf).where("id % 2 = 0")).select("seq"))
query("new_sources_anti", f", q AS ({_REQ} UNION ALL SELECT name, url, category, source_type, crawl_frequency, 0 FROM sources) SELECT seq, url, EXISTS (SELECT 1 FROM sources s WHERE s.url = q.url) AS conflict FROM q")(
    lambda spark, sf: J.new_sources_anti(_requests(spark, sf).unionByName(S.sources(spark, sf).select("name", "url", "category", "source_type", "crawl_frequency", F.lit(0).cast("long").alias("seq"))), S.sources(spark, sf)).select("seq", "url", "conflict")
)
query("exact_duplicates_semi", "SELECT id FROM articles WHERE content_hash IN (SELECT content_hash FROM content_hashes WHERE duplicate_count > 0)")(lambda spark, sf: J.exact_duplicates_semi(S.articles(spark, sf), S.content_hashes(spark, sf).where("duplicate_count > 0")).select("id"))
_BAND = f"SELECT p.id AS probe_id, a.id, a.quality_score FROM (SELECT * FROM articles WHERE id % 50 = 0) p JOIN articles a ON a.crawled_at >= {NOW} - INTERVAL 30 DAY AND a.id <> p.id AND length(a.content)::DOUBLE BETWEEN length(p.content)::DOUBLE * 0.7::DOUBLE AND length(p.content)::DOUBLE * 1.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY a.quality_score DESC, a.id) <= 50"
query("length_band_pairs", _BAND)(
    lambda spark, sf: J.length_band_pairs(S.articles(spark, sf).where("id % 50 = 0"), S.articles(spark, sf), now())
)


def _observed(spark, sf):
    return S.articles(spark, sf).select("url", F.when(F.col("id") % 3 == 0, F.lit("other")).otherwise(F.col("etag")).alias("etag"), F.when(F.col("id") % 2 == 0, F.col("last_modified")).alias("last_modified"))


query("freshness_join", "SELECT url, coalesce((CASE WHEN id % 3 = 0 THEN 'other' ELSE etag END) = etag OR (CASE WHEN id % 2 = 0 THEN last_modified END) = last_modified, false) AS is_fresh FROM articles")(lambda spark, sf: J.freshness_join(_observed(spark, sf), S.articles(spark, sf)))


def _queries(spark, sf):
    return S.raw(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = "round(list_dot_product(q.embedding::DOUBLE[], a.content_embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(a.content_embedding::DOUBLE[], a.content_embedding::DOUBLE[]))), 6)"
_QV = "(SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q"
query("cosine_pairs", f"SELECT * FROM (SELECT query_id, id, {_COS} AS similarity FROM {_QV}, articles_emb a WHERE content_embedding IS NOT NULL) WHERE similarity >= 0.3")(lambda spark, sf: M.cosine_pairs(_queries(spark, sf), S.articles_emb(spark, sf), 0.3))
query("semantic_search", f", f AS (SELECT query_id, id, title, content, {_COS} AS similarity FROM {_QV}, articles_emb a WHERE content_embedding IS NOT NULL) SELECT query_id, id, title, similarity, CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS preview FROM f WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10")(
    lambda spark, sf: M.semantic_search(_queries(spark, sf), S.articles_emb(spark, sf), 10, 0.1)
)
query("semantic_search_index")(lambda spark, sf: V.pq_search(_queries(spark, sf), S.articles_emb(spark, sf)))
_VECTOR = [((7 * k) % 13 - 6) / 10 for k in range(64)]
query("topk_similarity", f"SELECT id, {_COS} AS similarity FROM (SELECT {_VECTOR} AS embedding) q, articles_emb a WHERE content_embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 10")(lambda spark, sf: M.topk_similarity(S.articles_emb(spark, sf), _VECTOR))
_NEAR = _COS.replace("q.embedding", "q.content_embedding")
query("similar_articles", f"SELECT a.id, {_NEAR} AS similarity FROM articles_emb q JOIN articles_emb a USING (category) WHERE q.id = 7 AND a.id <> 7 AND a.content_embedding IS NOT NULL ORDER BY similarity DESC, a.id LIMIT 5")(lambda spark, sf: M.similar_articles(S.articles_emb(spark, sf), 7))
query("similar_articles_per_article", f"SELECT q.id, a.id AS other_id, {_NEAR} AS similarity FROM articles_emb q JOIN articles_emb a ON q.category = a.category AND a.id <> q.id WHERE a.content_embedding IS NOT NULL AND q.content_embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY similarity DESC, a.id) <= 5")(
    lambda spark, sf: M.similar_per_article(S.articles_emb(spark, sf))
)
query("similar_articles_same_label", f"SELECT q.id, a.id AS other_id, {_NEAR} AS similarity FROM articles_emb q JOIN articles_emb a ON q.category || q.emb_category = a.category || a.emb_category AND a.id <> q.id WHERE a.content_embedding IS NOT NULL AND q.content_embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY similarity DESC, a.id) <= 5")(
    lambda spark, sf: M.similar_per_article(S.articles_emb(spark, sf).withColumn("category", F.concat("category", F.col("emb_category").cast("string"))))
)
query("similar_articles_whole_category", ORACLES["similar_articles_per_article"], "")(QUERIES["similar_articles_per_article"])  # its name of old
query("embedding_backfill", "SELECT id, true AS processed FROM articles_emb WHERE content_embedding IS NULL OR id % 3 <> 0 ORDER BY crawled_at DESC, id LIMIT 1000")(lambda spark, sf: M.embedding_backfill(S.articles_emb(spark, sf).withColumn("is_processed", F.col("id") % 3 == 0), now()))

# -- aggregates -------------------------------------------------------------------------------------

_Q = "round(coalesce(avg(quality_score), 0.0), 2)"


def _ago(column: str, days: int) -> str:
    return f"{column} >= {NOW} - INTERVAL {days} DAY"


query("dashboard_counts", f"SELECT count(*) AS total_articles, count(*) FILTER (crawled_at >= {NOW}) AS articles_today, count(*) FILTER ({_ago('crawled_at', 7)}) AS articles_this_week, count(*) FILTER ({_ago('crawled_at', 30)}) AS articles_this_month, {_Q} AS avg_quality_score FROM articles")(lambda spark, sf: A.dashboard_counts(S.articles(spark, sf), now()))
query("top_categories", f"SELECT category, count(*) AS article_count, {_Q} AS avg_quality, count(*) FILTER ({_ago('crawled_at', 7)}) AS recent_count, round(count(*) FILTER ({_ago('crawled_at', 7)}) / greatest(count(*), 1) * 100, 1) AS growth_rate FROM articles GROUP BY category ORDER BY article_count DESC, category LIMIT 10")(lambda spark, sf: A.top_categories(S.articles(spark, sf), now()))
query("top_sources", f", {_PER} SELECT name, url AS base_url, articles AS article_count, round(coalesce(quality, 0.0), 2) AS avg_quality, round(coalesce(trust_score, 0.0), 2)::DOUBLE AS trust_score, recent AS recent_count, round(recent / greatest(articles, 1) * 100, 1) AS growth_rate FROM sa ORDER BY article_count DESC, name LIMIT 10")(lambda spark, sf: A.top_sources(S.sources(spark, sf), S.articles(spark, sf), now()))
query("crawl_success_rate", f"SELECT round(coalesce(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / nullif(count(*), 0), 0.0), 1) AS success_rate FROM crawl_jobs WHERE {_ago('started_at', 10)}")(lambda spark, sf: A.crawl_success_rate(S.crawl_jobs(spark, sf), now() - F.expr("interval 9 days")))
query("quality_distribution", "SELECT CASE WHEN quality_score >= 0.8 THEN 'high' WHEN quality_score >= 0.6 THEN 'medium' WHEN quality_score >= 0.4 THEN 'low' ELSE 'very_low' END AS quality_level, count(*) AS article_count FROM articles GROUP BY 1")(lambda spark, sf: A.quality_distribution(S.articles(spark, sf)))
query("daily_trends", f"SELECT crawled_at::DATE AS date, count(*) AS article_count, {_Q} AS avg_quality FROM articles WHERE {_ago('crawled_at', 30)} GROUP BY 1")(lambda spark, sf: A.daily_trends(S.articles(spark, sf), now()))
query("top_keywords", f"SELECT keyword, count(*) AS frequency FROM (SELECT unnest(tags) AS keyword FROM articles WHERE {_ago('crawled_at', 30)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda spark, sf: A.top_keywords(S.articles(spark, sf), now()))


def _sketches(spark, sf) -> DataFrame:
    """Sketches of all days, written a third of the days at a time."""
    a, at = S.articles(spark, sf), scratch(spark)
    for k in range(3):
        K_.refresh(a.where(F.pmod(F.dayofmonth("crawled_at"), F.lit(3)) == k), at)
    return K_.stored(spark, at)


_SPANS = "(SELECT unnest([7, 30]) AS days) s JOIN articles ON crawled_at >= {now} - to_days(days)"


@query("sketched_uniques", f"SELECT days, count(*)::BIGINT AS articles, true AS within FROM {_SPANS.format(now=NOW)} GROUP BY days")
def _(spark, sf):
    """Articles of 7 and 30 days, and whether the merged sketches tell how many differ within three standard deviations."""
    days, a = _sketches(spark, sf), S.articles(spark, sf)
    out = None
    for n in (7, 30):
        exact = a.where(F.col("crawled_at") >= now() - F.expr(f"interval {n} days")).agg(F.count_distinct("content_hash").alias("exact"))
        one = K_.uniques(days, now(), n).crossJoin(exact)
        one = one.select("days", "articles", (F.abs(F.col("unique_articles") - F.col("exact")) <= 3 * K_.ERROR * F.col("exact") + 1).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


query("sketched_keywords", f"SELECT days, keyword, count(*) AS frequency FROM (SELECT days, unnest(tags) AS keyword FROM {_SPANS.format(now=NOW)}) GROUP BY days, keyword QUALIFY row_number() OVER (PARTITION BY days ORDER BY count(*) DESC, keyword) <= 20")(
    lambda spark, sf: (lambda days: K_.keywords(days, now(), 7).unionByName(K_.keywords(days, now(), 30)))(_sketches(spark, sf))
)
query("duplication_stats", "SELECT count(*) AS total_articles, count(DISTINCT content_hash) AS unique_articles, count(*) - count(DISTINCT content_hash) AS duplicates, round((count(*) - count(DISTINCT content_hash)) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS duplication_rate FROM articles")(lambda spark, sf: A.duplication_stats(S.articles(spark, sf)))
_PERF = "round(least(CASE WHEN articles > 100 THEN 30 WHEN articles > 50 THEN 20 WHEN articles > 10 THEN 10 ELSE 0 END + coalesce(quality, 0.0::DOUBLE) * 40 + CASE WHEN recent > 10 THEN 20 WHEN recent > 5 THEN 15 WHEN recent > 0 THEN 10 ELSE 0 END + coalesce(trust_score, 0.0)::DOUBLE * 10, 100.0), 1)"
query("source_performance", f", {_PER} SELECT id AS source_id, name, url AS base_url, round(coalesce(trust_score, 0.0), 2)::DOUBLE AS trust_score, articles AS total_articles, round(coalesce(quality, 0.0), 2) AS avg_quality, recent AS recent_articles, day AS today_articles, last_crawl, categories AS category_diversity, {_PERF} AS performance_score FROM sa")(lambda spark, sf: A.source_performance(S.sources(spark, sf), S.articles(spark, sf), now()))
query("source_daily", f"SELECT source_id, crawled_at::DATE AS date, count(*) AS article_count FROM articles WHERE {_ago('crawled_at', 30)} GROUP BY 1, 2")(lambda spark, sf: A.source_daily(S.articles(spark, sf), now()))
query("source_categories", f"SELECT source_id, category, count(*) AS article_count, {_Q} AS avg_quality FROM articles GROUP BY 1, 2")(lambda spark, sf: A.source_categories(S.articles(spark, sf)))
query("running_and_active", "SELECT (SELECT count(*) FROM sources WHERE is_active) AS active_sources, (SELECT count(*) FROM crawl_jobs WHERE status = 'running') AS running_jobs")(lambda spark, sf: A.running_and_active(S.sources(spark, sf), S.crawl_jobs(spark, sf)))
_HEALTH = f", m AS (SELECT coalesce(avg(value) FILTER (metric_name = 'cpu_usage'), 0) AS cpu, coalesce(avg(value) FILTER (metric_name = 'memory_usage'), 0) AS mem, coalesce(avg(value) FILTER (metric_name = 'disk_usage'), 0) AS disk, count(*) AS n FROM system_metrics WHERE recorded_at >= {NOW} - INTERVAL 1 HOUR), h AS (SELECT *, 100 - CASE WHEN n > 0 THEN CASE WHEN cpu > 80 THEN 20 WHEN cpu > 60 THEN 10 ELSE 0 END + CASE WHEN mem > 90 THEN 20 WHEN mem > 70 THEN 10 ELSE 0 END + CASE WHEN disk > 90 THEN 30 WHEN disk > 80 THEN 15 ELSE 0 END ELSE 10 END AS s FROM m) SELECT greatest(s, 0) AS health_score, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 50 THEN 'warning' ELSE 'critical' END AS status, round(cpu, 1) AS cpu_usage, round(mem, 1) AS memory_usage, round(disk, 1) AS disk_usage FROM h"
query("system_health", _HEALTH)(lambda spark, sf: A.system_health(S.system_metrics(spark, sf), now()))
query("underperforming_sources", f", {_PER} SELECT name, articles AS article_count, round(quality, 6) AS avg_quality FROM sa WHERE is_active AND (articles < 10 OR quality < 0.4)")(lambda spark, sf: A.underperforming_sources(S.sources(spark, sf), S.articles(spark, sf), now()))
_EMERGE = f"SELECT category, count(*) FILTER ({_ago('crawled_at', 7)}) AS recent_count, count(*) FILTER ({_ago('crawled_at', 30)} AND NOT {_ago('crawled_at', 7)}) AS previous_count FROM articles GROUP BY category"
query("emerging_categories_now", f"SELECT *, round((recent_count - previous_count) * 100.0::DOUBLE / previous_count, 1) AS growth_rate FROM ({_EMERGE}) WHERE recent_count > 5 AND previous_count > 0 AND (recent_count - previous_count) * 100.0 / previous_count > 50")(lambda spark, sf: A.emerging_categories(S.articles(spark, sf), now()))
#: At this moment, early in the tables' month, some categories grow.
_THEN = "2024-01-10 00:00:00"
_EARLY = _EMERGE.replace(NOW, f"TIMESTAMP '{_THEN}'")
query("emerging_categories", f"SELECT *, round((recent_count - previous_count) * 100.0::DOUBLE / previous_count, 1) AS growth_rate FROM ({_EARLY}) WHERE recent_count > 5 AND previous_count > 0 AND (recent_count - previous_count) * 100.0 / previous_count > 50")(lambda spark, sf: A.emerging_categories(S.articles(spark, sf), S.as_of(_THEN)))
_ALERT = f"SELECT round(100.0::DOUBLE * avg(CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0.0 END), 1) AS success_rate, count(*) AS total_jobs FROM crawl_jobs WHERE {_ago('started_at', 10)} HAVING count(*) > 0 AND avg(CASE WHEN status = 'completed' THEN 100.0 ELSE 0.0 END) < 80"
query("crawl_efficiency_alert", _ALERT)(lambda spark, sf: A.crawl_efficiency_alert(S.crawl_jobs(spark, sf), now() - F.expr("interval 9 days")))
_RANKED = f"{_PER}, u AS (SELECT name, articles AS article_count, row_number() OVER (ORDER BY round(quality, 6) NULLS LAST, name) AS k FROM sa WHERE is_active AND (articles < 10 OR quality < 0.4)), e AS (SELECT *, row_number() OVER (ORDER BY recent_count DESC, category) AS k FROM (SELECT *, round((recent_count - previous_count) * 100.0::DOUBLE / previous_count, 1) AS growth_rate FROM ({_EMERGE}) WHERE recent_count > 5 AND previous_count > 0 AND (recent_count - previous_count) * 100.0 / previous_count > 50)), al AS ({_ALERT})"
_INSIGHTS = f", {_RANKED} SELECT * FROM (SELECT 'warning' AS type, 'underperforming sources' AS title, count(*) AS size, to_json(list({{'name': name, 'article_count': article_count}} ORDER BY k) FILTER (WHERE k <= 5))::VARCHAR AS payload FROM u UNION ALL SELECT 'info', 'emerging categories', count(*), to_json(list({{'category': category, 'recent_count': recent_count, 'previous_count': previous_count, 'growth_rate': growth_rate}} ORDER BY k) FILTER (WHERE k <= 3))::VARCHAR FROM e UNION ALL SELECT 'error', 'crawl efficiency', total_jobs, to_json({{'success_rate': success_rate, 'total_jobs': total_jobs}})::VARCHAR FROM al) WHERE size > 0"
query("insights", _INSIGHTS)(lambda spark, sf: A.insights(S.sources(spark, sf), S.articles(spark, sf), S.crawl_jobs(spark, sf).withColumn("started_at", F.col("started_at") + F.expr("interval 9 days")), now()))
query("sources_stats", f"SELECT count(*) AS total_sources, count(*) FILTER (is_active) AS active_sources, count(*) FILTER ({_ago('last_crawled', 1)}) AS crawled_today, {_Q} AS avg_quality, count(DISTINCT category) AS categories FROM sources")(lambda spark, sf: A.sources_stats(S.sources(spark, sf), now()))
query("sources_by_category", f"SELECT category, count(*) AS source_count, {_Q} AS avg_quality FROM sources WHERE is_active GROUP BY category")(lambda spark, sf: A.sources_by_category(S.sources(spark, sf)))
query("articles_stats", f"SELECT count(*) AS total_articles, count(*) FILTER ({_ago('crawled_at', 1)}) AS articles_24h, count(*) FILTER ({_ago('crawled_at', 7)}) AS articles_7d, {_Q} AS avg_quality, count(DISTINCT language) AS languages FROM articles")(lambda spark, sf: A.articles_stats(S.articles(spark, sf), now()))
query("articles_by_language", "SELECT language, count(*) AS article_count FROM articles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda spark, sf: A.articles_by_language(S.articles(spark, sf)))
query("hash_stats", "SELECT count(*) AS total_hashes, sum(duplicate_count)::BIGINT AS total_duplicates, round(avg(duplicate_count), 6) AS avg_duplicates_per_hash, count(*) FILTER (duplicate_count > 0) AS hashes_with_duplicates FROM content_hashes")(lambda spark, sf: A.hash_stats(S.content_hashes(spark, sf)))
query("successful_queries", f"SELECT search_query, round(avg(tech_relevance_score), 6) AS avg_score, count(*) AS n FROM discovery_results WHERE {_ago('discovered_at', 30)} AND is_tech_relevant GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10")(lambda spark, sf: A.successful_queries(S.discovery_results(spark, sf), now()))
query("duplicate_sources", "SELECT url, list(id ORDER BY created_at, id) AS ids, list(id ORDER BY created_at, id)[2:] AS redundant FROM sources_dup GROUP BY url HAVING count(*) > 1")(lambda spark, sf: A.duplicate_sources(S.sources_dup(spark, sf)))
_OUT = "SELECT source_id, CASE status WHEN 'failed' THEN 'failed' WHEN 'pending' THEN 'duplicate' WHEN 'running' THEN 'updated' ELSE 'new' END AS outcome, CASE WHEN status = 'failed' THEN 'error ' || id % 7 END AS error FROM crawl_jobs"


def _runs(spark, sf):
    s = F.col("status")
    return S.crawl_jobs(spark, sf).select("source_id", F.when(s == "failed", "failed").when(s == "pending", "duplicate").when(s == "running", "updated").otherwise("new").alias("outcome"), F.when(s == "failed", F.concat(F.lit("error "), (F.col("id") % 7).cast("string"))).alias("error"))


query("crawl_run_stats", f", o AS ({_OUT}), er AS (SELECT source_id, list(error ORDER BY n DESC, error) AS errors FROM (SELECT source_id, error, count(*) AS n FROM o WHERE error IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, error) <= 5) GROUP BY 1) SELECT source_id, coalesce(any_value(errors), []) AS errors, count(*) AS crawled, count(*) FILTER (outcome <> 'failed') AS processed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'duplicate') AS duplicate FROM o LEFT JOIN er USING (source_id) GROUP BY source_id")(lambda spark, sf: A.crawl_run_stats(_runs(spark, sf)))
query("rate_domain_stats", f"SELECT domain, count(*) FILTER (ts >= {NOW} - INTERVAL 60 SECOND) AS recent_requests, count(*) FILTER (status_code <> 200) AS errors, datediff('microsecond', max(ts), {NOW}) // 1000000 AS last_request_ago, count(*) AS total_requests FROM request_log GROUP BY domain")(lambda spark, sf: A.rate_domain_stats(S.request_log(spark, sf), now()))
query("known_domains", "SELECT DISTINCT domain FROM sources WHERE is_active")(lambda spark, sf: A.known_domains(S.sources(spark, sf)))
query("discovery_run_stats", f", c AS (SELECT url, {S.sql_category('title', 'description')} AS category, {_VALID} AS valid FROM candidates) SELECT category, count(*) AS explored, count(*) FILTER (valid) AS discovered, count(*) FILTER (valid AND url NOT IN (SELECT url FROM sources)) AS added FROM c GROUP BY category")(
    lambda spark, sf: A.discovery_run_stats(S.candidates(spark, sf).select("seq", "url", scores.detect_category(F.col("title"), F.col("description")).alias("category")).join(K.valid_candidates(S.candidates(spark, sf)).select("seq", F.lit(True).alias("v")), "seq", "left").withColumn("valid", F.coalesce("v", F.lit(False))), S.sources(spark, sf))
)

# -- windows and sets -------------------------------------------------------------------------------

query("first_candidate_per_domain", "SELECT seq, domain FROM candidates QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1")(lambda spark, sf: J.first_per_domain(S.candidates(spark, sf)).select("seq", "domain"))
_GONE = "(SELECT id FROM sources_dup QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at, id) > 1)"
query("oldest_source_per_url", f"SELECT id FROM sources_dup WHERE id NOT IN {_GONE}")(lambda spark, sf: J.oldest_per_url(S.sources_dup(spark, sf), S.articles_dup(spark, sf))[0].select("id"))
query("oldest_source_articles", f"SELECT id, source_id FROM articles_dup WHERE source_id NOT IN {_GONE}")(lambda spark, sf: J.oldest_per_url(S.sources_dup(spark, sf), S.articles_dup(spark, sf))[1].select("id", "source_id"))


def _versions(spark, sf):
    """Articles as versions of 40 urls."""
    return S.articles(spark, sf).withColumn("url", F.concat_ws("/", "source_id", (F.col("id") % 2).cast("string")))


query("latest_article_per_url", "SELECT id, url FROM (SELECT * REPLACE (source_id || '/' || (id % 2) AS url) FROM articles) QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, id DESC) = 1")(lambda spark, sf: J.latest_per_url(_versions(spark, sf)).select("id", "url"))
query("rate_violations", ", w AS (SELECT event_id, domain, count(*) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW) AS in_1s, count(*) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN INTERVAL 10 SECOND PRECEDING AND CURRENT ROW) AS in_10s, count(*) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_60s, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, event_id) AS gap_us FROM request_log) SELECT * FROM w WHERE in_1s > 1 OR in_10s > 3 OR in_60s > 10")(lambda spark, sf: J.rate_violations(S.request_log(spark, sf)))
_JACCARD = "len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v)))"
_CHANGED = f", l AS (SELECT id, content, lag(content) OVER (PARTITION BY source_id, id % 2 ORDER BY crawled_at, id) AS old FROM articles), j AS (SELECT id, content, old, list_distinct({S.sql_tokens('lower(content)')}) AS w, list_distinct({S.sql_tokens('lower(old)')}) AS v FROM l WHERE old IS NOT NULL), c AS (SELECT id, coalesce({_JACCARD}, 0) AS s, length(content) - length(old) AS length_change FROM j) SELECT id, round(s, 6) AS similarity, s < 0.9 AS is_significant, length_change::INT AS length_change, round((1 - s) * 100, 4) AS change_percentage, CASE WHEN s > 0.95 THEN 'minor_edit' WHEN s > 0.8 THEN 'content_update' WHEN s > 0.5 THEN 'major_revision' ELSE 'complete_rewrite' END AS update_type FROM c"
query("content_versions", _CHANGED)(lambda spark, sf: M.content_versions(_versions(spark, sf), "jaccard"))
query("detect_content_update")(lambda spark, sf: M.content_versions(_versions(spark, sf), "sequence"))
query("candidate_union", "SELECT seq, source_engine FROM candidates")(lambda spark, sf: J.candidate_union(*[S.candidates(spark, sf).where(F.col("source_engine") == e).select("seq", "source_engine") for e in P.ADAPTERS]))


def _urls(spark, sf, start: int):
    c = S.candidates(spark, sf).where((F.col("seq") % 4 == start) | (F.col("seq") % 8 == start))
    return c.select(F.col("domain").alias("source_id"), "url", "seq")


_FRONT = ", p AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT domain AS source_id, url, seq, {k} AS origin FROM candidates WHERE seq % 4 = {k} OR seq % 8 = {k} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq, url) <= {n})" for k, n in enumerate((1, 4, 2, 8))) + "), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY origin, seq) = 1) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY origin, seq, url) <= 8"
query("url_frontier", _FRONT)(lambda spark, sf: J.url_frontier(*[_urls(spark, sf, k) for k in range(4)], 8))
_BASE = ", b AS (SELECT row_number() OVER (ORDER BY search_query) - 1 AS seq, search_query AS query FROM (SELECT DISTINCT search_query FROM discovery_results))"
_TREND = "(VALUES " + ", ".join(f"({k}, {S._q(t)})" for k, t in enumerate(fixed.TRENDING)) + ") AS t(seq, query)"
_POOL = _BASE + f" SELECT DISTINCT query FROM (SELECT query FROM b UNION ALL SELECT query FROM {_TREND} UNION ALL SELECT query || ' 2024' FROM {_TREND} WHERE seq < 5 UNION ALL SELECT query || ' ' || m FROM b, (SELECT unnest({fixed.MODIFIERS}) AS m) WHERE seq < 5) ORDER BY query LIMIT 20"


def _pool(spark, sf):
    q = S.discovery_results(spark, sf).select(F.col("search_query").alias("query")).distinct()
    return J.query_pool(q, q, 2024)


query("query_pool", _POOL)(_pool)
query("suggestions", ", m AS (SELECT * FROM articles WHERE title ILIKE '%en%' OR len(list_filter(tags, lambda t: t ILIKE '%en%')) > 0 ORDER BY quality_score DESC, id LIMIT 10) SELECT DISTINCT suggestion FROM (SELECT title AS suggestion FROM m UNION ALL SELECT unnest(tags) FROM m) WHERE contains(lower(suggestion), 'en') ORDER BY 1 LIMIT 5")(lambda spark, sf: J.suggestions(S.articles(spark, sf), "en"))
query("keyword_token_set", f"SELECT id, list_sort(list_intersect(list_distinct({S.sql_tokens('lower(content)')}), {list(fixed.TECH_WEIGHTS)})) AS words FROM articles")(lambda spark, sf: S.articles(spark, sf).select("id", J.keyword_token_set(F.col("content")).alias("words")))
query("ranked_candidates", "SELECT id, tech_relevance_score FROM discovery_results ORDER BY tech_relevance_score DESC, discovered_url, id LIMIT 100")(lambda spark, sf: S.discovery_results(spark, sf).withColumn("url", F.col("discovered_url")).orderBy(F.desc("tech_relevance_score"), "url", "id").limit(100).select("id", "tech_relevance_score"))

# -- writes -----------------------------------------------------------------------------------------


def _stored(spark, sf):
    return S.articles(spark, sf).where("id % 3 <> 0").select("url", "title", "content", "content_hash", "author", "published_at", "crawled_at")


def _batch(spark, sf):
    changed = F.when(F.col("id") % 4 == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))
    return S.articles(spark, sf).where("id % 5 <> 1").withColumn("content", changed).withColumn("content_hash", scores.content_hash(F.col("content")))


query("upsert_articles", r", n AS (SELECT url, title, CASE WHEN id % 4 = 0 THEN content || ' more' ELSE content END AS content FROM articles WHERE id % 5 <> 1), n2 AS (SELECT *, sha256(regexp_replace(lower(regexp_replace(content, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS content_hash FROM n), o AS (SELECT url, content_hash FROM articles WHERE id % 3 <> 0) SELECT url, CASE WHEN n2.content_hash IS NULL THEN o.content_hash ELSE n2.content_hash END AS content_hash, CASE WHEN n2.content_hash IS NULL THEN 'kept' WHEN o.content_hash IS NULL THEN 'new' WHEN o.content_hash <> n2.content_hash THEN 'updated' ELSE 'unchanged' END AS outcome FROM o FULL JOIN n2 USING (url)")(
    lambda spark, sf: I.upsert_articles(_stored(spark, sf), _batch(spark, sf), now()).select("url", "content_hash", "outcome")
)
query("register_hashes", ", o AS (SELECT * FROM content_hashes WHERE first_article_id % 2 = 0), n AS (SELECT content_hash, count(*) AS n, arg_min(id, (crawled_at, id)) AS f, min(crawled_at) AS a, max(crawled_at) AS z, max(length(content)) AS l FROM articles GROUP BY 1) SELECT content_hash, coalesce(first_article_id, f) AS first_article_id, CASE WHEN duplicate_count IS NULL THEN n - 1 ELSE duplicate_count + coalesce(n, 0) END AS duplicate_count, coalesce(first_seen_at, a) AS first_seen_at, greatest(last_seen_at, z) AS last_seen_at, coalesce(content_length, l) AS content_length FROM o FULL JOIN n USING (content_hash)")(
    lambda spark, sf: I.register_hashes(S.content_hashes(spark, sf).where("first_article_id % 2 = 0"), S.articles(spark, sf))
)


def _scored(spark, sf):
    return D.score_candidates(S.candidates(spark, sf))


query("save_discoveries", f", c AS (SELECT *, {S.sql_tech_relevance('title', 'description', 'domain')} AS t FROM candidates QUALIFY row_number() OVER (PARTITION BY search_query, url ORDER BY seq) = 1) SELECT seq, t >= 0.7 AS is_tech_relevant FROM c WHERE NOT EXISTS (SELECT 1 FROM discovery_results d WHERE d.id % 3 = 0 AND d.search_query = c.search_query AND d.discovered_url = c.url)")(
    lambda spark, sf: I.save_discoveries(_scored(spark, sf), S.discovery_results(spark, sf).where("id % 3 = 0")).select("seq", "is_tech_relevant")
)
_BEST = "(SELECT * FROM discovery_results WHERE tech_relevance_score >= 0.7 AND NOT became_source AND is_tech_relevant ORDER BY tech_relevance_score DESC, id LIMIT 50)"
query("promote_discoveries", f"SELECT CASE WHEN title <> '' THEN title ELSE domain END AS name, discovered_url AS url, domain, {S.sql_source_type('domain')} AS source_type, {S.sql_category('title', 'description')} AS category FROM {_BEST}")(lambda spark, sf: I.promote_discoveries(S.discovery_results(spark, sf))[0].select("name", "url", "domain", "source_type", "category"))
query("mark_promoted", f"SELECT id, became_source OR id IN (SELECT id FROM {_BEST}) AS became_source FROM discovery_results")(lambda spark, sf: I.promote_discoveries(S.discovery_results(spark, sf))[1].select("id", "became_source"))
query("update_source_stats", f", f AS (SELECT source_id AS id, count(*) FILTER (status = 'failed') AS failed FROM crawl_jobs GROUP BY 1) SELECT id, CASE WHEN failed IS NOT NULL THEN {NOW} ELSE last_crawled END AS last_crawled, crawl_count + CASE WHEN failed IS NOT NULL THEN 1 ELSE 0 END AS crawl_count, error_count + coalesce(failed, 0) AS error_count FROM sources LEFT JOIN f USING (id)")(
    lambda spark, sf: I.update_source_stats(S.sources(spark, sf), A.crawl_run_stats(_runs(spark, sf)), now())
)
query("toggle_sources", "SELECT id, CASE WHEN source_type = 'website' THEN NOT is_active ELSE is_active END AS is_active FROM sources")(lambda spark, sf: I.toggle_sources(S.sources(spark, sf), S.sources(spark, sf).where("source_type = 'website'")).select("id", "is_active"))
query("create_sources", _REASONS + " SELECT name, url, category, source_type, crawl_frequency FROM v WHERE len(reasons) = 0 AND url NOT IN (SELECT url FROM sources) QUALIFY row_number() OVER (PARTITION BY url ORDER BY name) = 1")(lambda spark, sf: I.create_sources(_requests(spark, sf), S.sources(spark, sf)).drop("domain"))
_VEC = "list_transform(range(0, 16), lambda i: ('0x' || substring(md5({0}), (i * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE - 0.5::DOUBLE)"
_BOTH = "(coalesce(title, '') || ' ' || coalesce(content, ''))"
query("embed_articles", f"SELECT id, list_transform({_VEC.format(_BOTH)}, lambda x: round(x, 6)) AS head, true AS is_processed FROM articles")(lambda spark, sf: I.embed_articles(S.articles(spark, sf), now()).select("id", F.transform(F.slice("content_embedding", 1, 16), lambda x: F.round(x, 6)).alias("head"), "is_processed"))

# -- scalar functions -------------------------------------------------------------------------------

_TXT = "substring(content, 1, 2000)"


def _scalar(name: str, column: str, sql: str, make, table: str = "articles") -> None:
    read = {"articles": lambda spark, sf: S.articles(spark, sf, heavy=True), "sources": S.sources}[table]
    query(name, f"SELECT id, {sql} AS {column} FROM {table}")(lambda spark, sf: read(spark, sf).select("id", make().alias(column)))


def _c(name: str):
    return F.col(name)


def _text():
    return F.concat_ws(" ", F.lit("how to learn the latest api"), "content")


_STXT = "('how to learn the latest api' || ' ' || content)"
_scalar("content_hash", "h", "content_hash", lambda: _c("content_hash"))
_scalar("url_hash", "h", "sha256(url)", lambda: scores.url_hash(_c("url")))
_SIG = S.sql_tokens("content").replace("x <> ''", "length(x) > 3")
query("structure_hash", f", w AS (SELECT id, {_SIG} AS w FROM articles), s AS (SELECT id, CASE WHEN len(w) > 50 THEN w[1:20] || w[len(w) // 2 - 9 : len(w) // 2 + 10] || w[-20:] ELSE w END AS w FROM w) SELECT id, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS h FROM s")(lambda spark, sf: S.articles(spark, sf, heavy=True).select("id", scores.structure_hash(F.col("content")).alias("h")))
_scalar("normalize_content", "t", r"regexp_replace(lower(content), '^\s+|\s+$', '', 'g')", lambda: scores.normalize(_c("content")))
_scalar("normalize_content_intended", "t", r"""regexp_replace(lower(regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '[.,;:!?()\[\]{}"'']', '', 'g')), '^\s+|\s+$', '', 'g')""", lambda: scores.normalize(_c("content"), "intended"))
_scalar("crawl_quality", "s", "quality_score", lambda: _c("quality_score"))
_EX = f"CASE WHEN title <> '' THEN 20 ELSE 0 END + CASE WHEN length(content) > 500 THEN 30 ELSE 0 END + CASE WHEN coalesce(author, '') <> '' THEN 10 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 10 ELSE 0 END + least({S.sql_hits('lower(content)', [(w, 5) for w in fixed.EXTRACT_WORDS])}, 20)"
_scalar("extraction_quality", "s", S.sql_clamp(_EX), lambda: scores.extraction_quality(_c("content"), _c("title"), _c("author"), _c("published_at"), _c("tags")))
_scalar("word_count", "n", f"len({S.sql_tokens('content')})", lambda: scores.word_count(_c("content")))
_STOPS = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(map(S._q, fixed.STOP_WORDS[k]))})))" for k in fixed.LANGUAGES}
_MOST = ", ".join(f"n_{k}" for k in fixed.LANGUAGES)
_GRAMS = "SELECT id, language, lower(substring(coalesce(content, ''), 1, 1000)) AS s FROM"
_BAYES = f""", m AS ({_GRAMS} (SELECT * FROM articles WHERE id % 5 <> 0 AND language IS NOT NULL ORDER BY md5(id::VARCHAR), id LIMIT 2000)),
g AS (SELECT language, substring(s, i, 3) AS g, count(*) AS n FROM (SELECT language, s, unnest(range(1, length(s) - 1)) AS i FROM m) GROUP BY ALL), v AS (SELECT count(DISTINCT g) AS v FROM g),
k AS (SELECT language, floor(1000 * ln(count(*)::DOUBLE / (SELECT count(*) FROM m)))::BIGINT AS prior, (SELECT sum(n) FROM g WHERE g.language = m.language)::DOUBLE + (SELECT v FROM v) AS total FROM m GROUP BY language),
u AS (SELECT *, floor(1000 * ln(1 / total))::BIGINT AS unknown FROM k), w AS (SELECT g, language, floor(1000 * ln((n + 1) / total))::BIGINT - unknown AS gain FROM g JOIN u USING (language)),
d AS ({_GRAMS} articles), t AS (SELECT id, substring(s, i, 3) AS g, count(*) AS n FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM d) GROUP BY ALL),
x AS (SELECT id, w.language AS l, sum(n * gain) AS gain FROM t JOIN w USING (g) GROUP BY ALL),
y AS (SELECT d.id, d.language, s, u.language AS l, prior + unknown * greatest(length(s) - 2, 0) + coalesce(gain, 0) AS score FROM d, u LEFT JOIN x ON x.id = d.id AND x.l = u.language)
SELECT id, language, CASE WHEN trim(s) = '' THEN 'en' ELSE l END AS detected FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, l) = 1"""


@query("language_detect", _BAYES)
def _(spark, sf):
    """Every article; the model has not seen those whose id is divisible by five."""
    a = S.articles(spark, sf)
    return N.detect(a, N.fit(a.where("id % 5 <> 0"))).select("id", "language", "detected")


query("language_detect_stop_words", f", w AS (SELECT id, language, {S.sql_tokens('lower(substring(content, 1, 1000))')} AS w FROM articles), n AS (SELECT id, language, {', '.join(f'{v} AS n_{k}' for k, v in _STOPS.items())} FROM w) SELECT id, language, CASE WHEN greatest({_MOST}) = 0 THEN 'en' " + " ".join(f"WHEN n_{k} = greatest({_MOST}) THEN '{k}'" for k in fixed.LANGUAGES) + " END AS detected FROM n")(lambda spark, sf: S.articles(spark, sf).select("id", "language", scores.detect_language(F.col("content")).alias("detected")))
_scalar("hash_embedding", "v", f"list_transform({_VEC.format('content')}, lambda x: round(x, 6))", lambda: F.transform(F.slice(scores.hash_embedding(_c("content")), 17, 16), lambda x: F.round(x, 6)))
_PAIR = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


@query("cosine_similarity", f"SELECT a.vec_id AS id, {_PAIR} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    """Each vector against the next one."""
    e = S.raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    return e.join(e.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id").select("id", F.round(scores.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


_scalar("tech_keyword_score", "s", f"round({S.sql_keyword_score(_STXT)}, 6)", lambda: F.round(scores.tech_keyword_score(_text()), 6))
_scalar("content_depth_score", "s", f"round({S.sql_depth(_STXT)}, 6)", lambda: F.round(scores.content_depth_score(_text()), 6))
_scalar("language_quality_score", "s", S.sql_language(_STXT), lambda: scores.language_quality_score(_text()))
_scalar("structure_score", "s", S.sql_structure(_STXT), lambda: scores.structure_score(_text()))
_scalar("relevance_score", "s", f"round({S.sql_relevance(_STXT)}, 6)", lambda: F.round(scores.relevance_score(_text()), 6))
_MATCH = "list_filter([" + ", ".join(f"CASE WHEN contains(lower({_STXT}), {S._q(k)}) THEN {S._q(k)} END" for k in fixed.TECH_WEIGHTS) + "], lambda x: x IS NOT NULL)"
_scalar("keyword_matches", "w", f"array_to_string({_MATCH}, ',')", lambda: F.array_join(scores.keyword_matches(_text()), ","))
query("explain_relevance", f"SELECT id, round({S.sql_keyword_score(_STXT)}, 6) AS tech_keywords_score, round({S.sql_depth(_STXT)}, 6) AS content_depth_score, {S.sql_language(_STXT)} AS language_quality_score, {S.sql_structure(_STXT)} AS structure_score, array_to_string({_MATCH}, ',') AS found, length({_STXT}) AS text_length FROM articles")(
    lambda spark, sf: S.articles(spark, sf, heavy=True).select("id", scores.explain_relevance(_text()).alias("e")).select("id", F.round("e.tech_keywords_score", 6).alias("tech_keywords_score"), F.round("e.content_depth_score", 6).alias("content_depth_score"), "e.language_quality_score", "e.structure_score", F.array_join("e.tech_keywords_found", ",").alias("found"), "e.text_length")
)
query("tech_relevance", "SELECT id, tech_relevance_score FROM discovery_results")(lambda spark, sf: S.discovery_results(spark, sf).select("id", "tech_relevance_score"))
_scalar("domain_reputation", "s", "quality_score", lambda: scores.domain_reputation(_c("domain")), "sources")
_HQ = f"50 + {S.sql_hits('lower(html)', [(w, 5) for w in fixed.PAGE_INDICATORS])} + CASE WHEN contains(html, '<title>') AND contains(html, '</title>') THEN 10 ELSE 0 END + CASE WHEN contains(html, '<meta name=\"description\"') THEN 10 ELSE 0 END + " + " + ".join(f"CASE WHEN regexp_matches(html, {S._q(p)}, 'i') THEN 5 ELSE 0 END" for p in fixed.PAGE_PATTERNS) + f" - {S.sql_hits('lower(html)', [(w, 5) for w in fixed.PAGE_SPAM])} + CASE WHEN length(html) > 5000 THEN 10 WHEN length(html) < 1000 THEN -10 ELSE 0 END"
query("html_quality", f"SELECT page_id, {_HQ} AS points FROM pages")(lambda spark, sf: S.raw(spark, sf, "pages").select("page_id", scores.html_quality(F.col("html")).alias("points")))
_scalar("source_type", "t", "source_type", lambda: _c("source_type"), "sources")
_scalar("detect_category", "t", "category", lambda: _c("category"))
_TI = "greatest(least(CASE WHEN https_status IS NOT NULL THEN 600 + CASE WHEN https_status = 200 THEN 200 WHEN https_status IN (301, 302) THEN 100 ELSE -200 END + CASE WHEN safe THEN 50 ELSE 0 END ELSE CASE WHEN http_status IS NULL THEN 100 WHEN http_status = 200 THEN 600 ELSE 200 END END, 1000), 0) / 1000.0"
query("technical_indicators", f"SELECT id, {_TI} AS s FROM response_meta")(lambda spark, sf: S.response_meta(spark, sf).select("id", scores.technical_indicators(F.col("https_status"), F.col("http_status"), F.col("headers")).alias("s")))


def _one_page(spark, sf):
    return S.page_hosts(spark, sf).groupBy("domain").agg(F.min_by("html", "page_id").alias("html"))


_PS = S.sql_clamp(f"CASE WHEN https_status = 200 THEN {_HQ} WHEN https_status IS NOT NULL THEN 50 WHEN http_status = 200 THEN {_HQ} - 10 WHEN http_status IS NOT NULL THEN 50 ELSE 30 END")
_DQ = f", pg AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain, arg_min(html, page_id) AS html FROM pages GROUP BY 1), dq AS (SELECT domain, list_avg(list_filter([{S.sql_reputation('domain')}, {_TI}, CASE WHEN html IS NOT NULL THEN {_PS} END], lambda x: x IS NOT NULL)) AS q, html, r.last_modified FROM response_meta r LEFT JOIN pg USING (domain))"


def _quality(spark, sf):
    return D.domain_quality(S.sources(spark, sf).select("domain"), S.response_meta(spark, sf).drop("id"), _one_page(spark, sf))


query("domain_quality", _DQ + " SELECT domain, round(q, 6) AS quality_score FROM dq")(_quality)


_ANSWER = "coalesce(https_status, http_status)"


@query("source_reliability", _DQ.replace("html, r.last_modified", "html, r.last_modified, r.https_status, r.http_status") + f" SELECT domain, round((round(q, 6) + CASE WHEN {_ANSWER} IS NULL THEN 0.5::DOUBLE WHEN last_modified IS NOT NULL THEN 0.8 ELSE 0.6 END + 0.7::DOUBLE + CASE WHEN {_ANSWER} = 200 AND html IS NOT NULL THEN CASE WHEN contains(html, 'github.com') OR contains(html, 'stackoverflow.com') THEN 0.8::DOUBLE ELSE 0.6 END ELSE 0.5 END) / 4, 5) AS overall FROM dq")
def _(spark, sf):
    return D.source_reliability(_quality(spark, sf).join(S.response_meta(spark, sf).select("domain", "https_status", "http_status", "last_modified"), "domain").join(_one_page(spark, sf), "domain", "left"))


query("domain_explanation", f"SELECT id, array_to_string(list_filter([CASE WHEN {S.sql_any('domain', fixed.KNOWN_TECH_SITES)} THEN 'known site' END, CASE WHEN ends_with(domain, '.edu') OR ends_with(domain, '.org') THEN 'organization' END], lambda x: x IS NOT NULL), ',') AS factors FROM sources")(
    lambda spark, sf: S.sources(spark, sf).select("id", F.array_join(F.array_compact(F.array(F.when(scores.any_of(F.col("domain"), fixed.KNOWN_TECH_SITES), F.lit("known site")), F.when(F.endswith("domain", F.lit(".edu")) | F.endswith("domain", F.lit(".org")), F.lit("organization")))), ",").alias("factors"))
)
query("growth_rate", f"SELECT source_id, round(count(*) FILTER ({_ago('crawled_at', 7)}) / greatest(count(*), 1) * 100, 1) AS g FROM articles GROUP BY 1")(lambda spark, sf: A.by_source(S.articles(spark, sf), now()).select(F.col("id").alias("source_id"), scores.growth_rate(F.col("articles"), F.col("recent")).alias("g")))
query("performance_score", f", {_PER} SELECT id, {_PERF} AS s FROM sa")(lambda spark, sf: A.source_performance(S.sources(spark, sf), S.articles(spark, sf), now()).select(F.col("source_id").alias("id"), F.col("performance_score").alias("s")))
_HP = "CASE WHEN value > 80 THEN 20 WHEN value > 60 THEN 10 ELSE 0 END + CASE WHEN value > 90 THEN 20 WHEN value > 70 THEN 10 ELSE 0 END + CASE WHEN value > 90 THEN 30 WHEN value > 80 THEN 15 ELSE 0 END"
query("health_penalty", f"SELECT id, 100 - ({_HP}) AS s FROM system_metrics")(lambda spark, sf: S.system_metrics(spark, sf).select("id", scores.health_score(F.col("value"), F.col("value"), F.col("value"), F.lit(1)).alias("s")))
query("update_type", "SELECT id, CASE WHEN value / 100 > 0.95 THEN 'minor_edit' WHEN value / 100 > 0.8 THEN 'content_update' WHEN value / 100 > 0.5 THEN 'major_revision' ELSE 'complete_rewrite' END AS t FROM system_metrics")(lambda spark, sf: S.system_metrics(spark, sf).select("id", scores.update_type(F.col("value") / 100).alias("t")))


@query("parse_dates", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN ts::DATE::TIMESTAMP WHEN 2 THEN ts::DATE::TIMESTAMP ELSE date_trunc('second', ts) END AS d FROM events")
def _(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 5
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, F.date_format(ts, "d/M/yyyy")).otherwise("soon")
    return S.raw(spark, sf, "events").select("event_id", scores.parse_date(text).cast("timestamp_ntz").alias("d"))


# -- corpus -----------------------------------------------------------------------------------------

query("exact_dedup", "SELECT id, content_hash, count(*) OVER (PARTITION BY content_hash) AS copies, row_number() OVER (PARTITION BY content_hash ORDER BY crawled_at, id) > 1 AS is_duplicate FROM articles")(lambda spark, sf: M.exact_dedup(S.articles(spark, sf)))
_SETS = f"t AS (SELECT id, unnest(list_distinct({S.sql_tokens('lower(content)')})) AS w FROM {{0}}), s AS (SELECT id, count(*) AS n FROM t GROUP BY id)"
query("near_dup_pairs", ", reps AS (SELECT min(id) AS id, min(content) AS content FROM articles WHERE length(content) > 200 GROUP BY content_hash), " + _SETS.format("reps") + ", p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM t x JOIN t y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2) SELECT a, b, round(k / (x.n + y.n - k), 6) AS similarity FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE round(k / (x.n + y.n - k), 6) >= 0.85")(lambda spark, sf: M.near_dup_pairs(S.articles(spark, sf, heavy=True)))


def _band(spark, sf):
    probes = S.articles(spark, sf).where("id % 50 = 0")
    return J.length_band_pairs(probes, S.articles(spark, sf), now()), probes, S.articles(spark, sf)


query("find_similar_content", f", band AS ({_BAND}), " + _SETS.format("articles") + ", k AS (SELECT probe_id, b.id, count(y.w) AS k FROM band b JOIN t x ON x.id = probe_id LEFT JOIN t y ON y.id = b.id AND y.w = x.w GROUP BY 1, 2) SELECT probe_id, k.id, round(k / (x.n + y.n - k), 6) AS similarity FROM k JOIN s x ON x.id = probe_id JOIN s y ON y.id = k.id WHERE round(k / (x.n + y.n - k), 6) >= 0.3")(lambda spark, sf: M.find_similar_content(*_band(spark, sf), 0.3, "jaccard"))
query("near_dup_sequence")(lambda spark, sf: M.sequence_matches(S.articles(spark, sf).where("id % 50 = 0"), S.articles(spark, sf, heavy=True)))
query("find_similar_sequence")(lambda spark, sf: M.find_similar_content(*_band(spark, sf)))
query("score_candidates", f"SELECT seq, round({S.sql_relevance(chr(40) + 'title || chr(32) || description' + chr(41))}, 6) AS relevance_score, {S.sql_tech_relevance('title', 'description', 'domain')} AS tech_relevance_score, {S.sql_reputation('domain')} AS quality_score FROM candidates")(lambda spark, sf: _scored(spark, sf).select("seq", "relevance_score", "tech_relevance_score", "quality_score"))
query("discovery_pipeline")(lambda spark, sf: D.discovery_pipeline(S.candidates(spark, sf), S.sources(spark, sf).where("length(id) % 2 = 0"), S.discovery_results(spark, sf).where("id % 9 = 0"), P.external_links(P.page_links(S.raw(spark, sf, "pages"))).join(S.raw(spark, sf, "pages").select("page_id", F.col("url").alias("page_url")), "page_id")))


def _start(spark, sf) -> D.CrawlState:
    return D.CrawlState(_stored(spark, sf), S.content_hashes(spark, sf), S.sources(spark, sf).select("id", "last_crawled", "crawl_count", "error_count"))


def _robots(spark, sf):
    return S.page_hosts(spark, sf).select("domain").distinct().where(F.length("domain") % 2 == 0).withColumn("robots_txt", F.lit("User-agent: *\nDisallow: /fr/\n"))


def _crawled(spark, sf):
    return D.crawl_batch(S.raw(spark, sf, "pages"), _start(spark, sf), now(), _robots(spark, sf))


#: Pages that may be fetched; every one of them has an article with text.
_MAY = f"may AS (SELECT domain AS id, count(*) AS n FROM {_HOSTS} WHERE NOT (length(domain) % 2 = 0 AND regexp_matches(url, '^[a-z]+://[^/?#]+/fr/')) GROUP BY 1)"
query("crawl_batch_pipeline")(lambda spark, sf: _crawled(spark, sf)[1])
query("crawl_batch_articles")(lambda spark, sf: _crawled(spark, sf)[0].articles.select("url", "content_hash", "crawled_at"))
query("crawl_batch_hashes")(lambda spark, sf: _crawled(spark, sf)[0].hashes)
query("crawl_batch_sources", f", {_MAY} SELECT id, CASE WHEN n IS NOT NULL THEN {NOW} ELSE last_crawled END AS last_crawled, crawl_count + CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS crawl_count, error_count FROM sources LEFT JOIN may USING (id)")(lambda spark, sf: _crawled(spark, sf)[0].sources)

# -- streams ----------------------------------------------------------------------------------------


def _stream(spark, sf):
    """The events table as a file stream."""
    return T.table_stream(spark, sf, "events", S.raw(spark, sf, "events").schema)


def _metrics_stream(spark, sf):
    names = F.array(F.lit("cpu_usage"), F.lit("memory_usage"), F.lit("disk_usage"))
    return T.event_time(_stream(spark, sf)).select("ts", F.get(names, (F.col("event_id") % 3).cast("int")).alias("metric_name"), F.least("value", F.lit(100.0)).alias("value"))


def _requests_stream(spark, sf):
    status = F.when(F.col("event_type") != "error", 200).when(F.col("event_id") % 2 == 0, 500).otherwise(429)
    return T.event_time(_stream(spark, sf)).select("event_id", "ts", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit(".example.org")).alias("domain"), status.alias("status_code"), (F.col("value") / 100).alias("response_time"))


def _hash_rows(events):
    return T.event_time(events).select("ts", F.sha2(F.concat_ws(":", "user_id", "event_type"), 256).alias("content_hash"))


def _hash_stream(spark, sf):
    return _hash_rows(_stream(spark, sf))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


query("stream_tumbling_metrics", "SELECT time_bucket(INTERVAL 15 MINUTE, recorded_at) AS start, metric_name, count(*) AS n, round(avg(value), 6) AS avg_value FROM system_metrics GROUP BY 1, 2")(lambda spark, sf: _plain(run_stream(T.tumbling(_metrics_stream(spark, sf)), "complete"), "start"))
query("stream_sliding_rate", "SELECT time_bucket(INTERVAL 1 SECOND, ts) - to_seconds(k) AS start, domain, count(*) AS requests FROM request_log, (SELECT unnest(range(0, 10)) AS k) GROUP BY 1, 2")(lambda spark, sf: _plain(run_stream(T.sliding_rate(_requests_stream(spark, sf)), "complete"), "start"))
query("stream_crawl_sessions", ", g AS (SELECT domain, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM request_log WINDOW w AS (PARTITION BY domain ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY domain ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", domain, count(*) AS requests FROM s GROUP BY domain, k")(lambda spark, sf: _plain(run_stream(T.crawl_sessions(_requests_stream(spark, sf)), "complete"), "start", "end"))
query("stream_dedup", "SELECT DISTINCT sha256(user_id || ':' || event_type) AS content_hash FROM events")(lambda spark, sf: run_stream(T.dedup(_hash_stream(spark, sf)), "append").select("content_hash"))
@query("stream_hash_registry", "SELECT sha256(user_id || ':' || event_type) AS content_hash, count(*) - 1 AS duplicate_count, max(ts) AS last_seen FROM events GROUP BY 1")
def _(spark, sf):
    """It starts from a registry of the first third of the events; the stream brings the others."""
    cut = "2024-01-11"
    first = _hash_rows(S.raw(spark, sf, "events").where(F.col("ts") < cut))
    stored = first.groupBy("content_hash").agg((F.count("*") - 1).alias("duplicate_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    with T.rocksdb(spark):
        out = run_stream(T.hash_registry(_hash_rows(_stream(spark, sf).where(F.col("ts") >= cut)), stored=stored), "update")
    last = out.where("not expired").groupBy("content_hash").agg(F.max("duplicate_count").alias("duplicate_count"), F.max("last_seen").alias("last_seen"))
    quiet = stored.join(last, "content_hash", "left_anti").select("content_hash", "duplicate_count", F.col("last_seen_at").alias("last_seen"))
    return _plain(last.unionByName(quiet), "last_seen")


def _late_files(spark, sf) -> DataFrame:
    """Events as a stream of three files, the last one of older events."""
    e, at = S.raw(spark, sf, "events").select("event_id", "ts"), scratch(spark)
    for part in (e.where("ts >= '2024-01-11' and ts < '2024-01-21'"), e.where("ts >= '2024-01-21'"), e.where("ts < '2024-01-11'")):
        part.coalesce(1).write.mode("append").parquet(at)
    return T.event_time(T.file_stream(spark, at, e.schema, "*.parquet", files=1))


@query("late_data", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= '2024-01-11' GROUP BY 1 HAVING date_trunc('day', any_value(ts)) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
def _(spark, sf):
    """Older events are late and dropped, and a day comes out once the watermark has passed it."""
    return _plain(run_stream(T.daily_counts(_late_files(spark, sf)), "append").select("day", "n"), "day")


query("late_rows", "SELECT count(*) FILTER (ts >= '2024-01-11') AS kept, count(*) FILTER (ts < '2024-01-11') AS dropped FROM events")(lambda spark, sf: T.late_rows(_late_files(spark, sf), ["event_id"]))


def _limits(spark, sf):
    """Presets, and limits like theirs for two of three domains of the log; the third has the defaults."""
    own = S.request_log(spark, sf).select("domain").distinct().withColumn("k", F.regexp_extract("domain", r"\d+", 0).cast("int") % 3).where("k < 2")
    low, high = fixed.DOMAIN_LIMITS["github.com"], fixed.DOMAIN_LIMITS["docker.com"]
    pick = lambda c: F.when(F.col("k") == 0, F.lit(low[c])).otherwise(F.lit(high[c])).alias(("rate", "burst", "delay")[c])
    return L.presets(spark).unionByName(own.select("domain", *[pick(c) for c in range(3)]))


#: The log is read at this many times its pace, so that requests get in each other's way.
_PACE = 3600


def _paced(spark, sf):
    return L_log(S.request_log(spark, sf)).withColumn("us", F.floor(F.col("us") / _PACE))


def L_log(log: DataFrame) -> DataFrame:
    return log.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_FOLD = """, o AS (SELECT domain, status_code AS c, response_time AS t, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS n FROM request_log),
f AS (SELECT DISTINCT domain, 0::BIGINT AS n, 1.0::DOUBLE AS rate, 3 AS burst, 1.0::DOUBLE AS delay, 0 AS errors FROM o UNION ALL
SELECT f.domain, o.n, CASE WHEN c = 429 THEN greatest(rate * 0.5::DOUBLE, 0.1) WHEN c >= 500 AND errors + 1 > 5 THEN greatest(rate * 0.8::DOUBLE, 0.2) WHEN c = 200 AND t < 1 AND errors <= 1 AND rate < 2 THEN least(rate * 1.1::DOUBLE, 2.0) ELSE rate END,
CASE WHEN c = 429 THEN greatest(burst - 1, 1) WHEN c = 200 AND t < 1 AND errors <= 1 AND rate < 2 THEN least(burst + 1, 10) ELSE burst END,
CASE WHEN c = 429 THEN least(delay * 2, 10.0) WHEN c >= 500 AND errors + 1 > 5 THEN least(delay * 1.5::DOUBLE, 5.0) WHEN c = 200 AND t < 1 AND errors <= 1 AND rate < 2 THEN greatest(delay * 0.95::DOUBLE, 0.5) ELSE delay END,
CASE WHEN c = 429 OR c >= 500 THEN errors + 1 WHEN c = 200 THEN greatest(errors - 1, 0) ELSE errors END
FROM f JOIN o ON o.domain = f.domain AND o.n = f.n + 1)
SELECT domain, arg_max(rate, n) AS rate, arg_max(burst, n) AS burst, arg_max(delay, n) AS delay, arg_max(errors, n) AS errors FROM f GROUP BY domain"""
_RECURSIVE = PRELUDE.replace("WITH", "WITH RECURSIVE", 1)
_LIMITED = """, lim AS (SELECT DISTINCT domain, CASE regexp_extract(domain, '[0-9]+')::INT % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS rate,
CASE regexp_extract(domain, '[0-9]+')::INT % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 3 END AS burst, CASE regexp_extract(domain, '[0-9]+')::INT % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS delay FROM request_log)"""
query("adaptive_rate_batch", _FOLD, _RECURSIVE)(lambda spark, sf: L.adaptive_rate(L_log(S.request_log(spark, sf))))
_PRESET_FOLD = _LIMITED + _FOLD.replace("SELECT DISTINCT domain, 0::BIGINT AS n, 1.0::DOUBLE AS rate, 3 AS burst, 1.0::DOUBLE AS delay, 0 AS errors FROM o", "SELECT domain, 0::BIGINT AS n, rate, burst, delay, 0 AS errors FROM lim")
query("adaptive_rate_presets", _PRESET_FOLD, _RECURSIVE)(lambda spark, sf: L.adaptive_rate(L_log(S.request_log(spark, sf)), _limits(spark, sf)))


@query("stream_adaptive_rate", _PRESET_FOLD, _RECURSIVE)
def _(spark, sf):
    """The same over a stream; domains of the presets that have no request stay out."""
    at = scratch(spark)
    done = L.adaptive_rate_stream(L_log(_requests_stream(spark, sf)), f"{at}/tables", f"{at}/checkpoint", _limits(spark, sf))
    return done.where(F.endswith("domain", F.lit(".example.org")))


_BUCKET = _LIMITED + f""", o AS (SELECT r.domain, event_id, epoch_us(ts) // {_PACE} AS us, row_number() OVER (PARTITION BY r.domain ORDER BY epoch_us(ts) // {_PACE}, event_id) AS n,
(rate * 1000)::BIGINT AS rate, burst::BIGINT * {L.TOKEN} AS most, round(delay * 1000000)::BIGINT AS delay FROM request_log r JOIN lim USING (domain)),
f AS (SELECT domain, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS granted, most AS tokens, us AS was, -1::BIGINT AS last FROM o WHERE n = 1 UNION ALL
SELECT domain, n, event_id, good, CASE WHEN good THEN had - {L.TOKEN} ELSE had END, us, CASE WHEN good THEN us ELSE last END
FROM (SELECT o.domain, o.n, o.event_id, o.us, last, least(most, tokens + (us - was) * rate) AS had, least(most, tokens + (us - was) * rate) >= {L.TOKEN} AND (last < 0 OR us - last >= delay) AS good
FROM f JOIN o ON o.domain = f.domain AND o.n = f.n + 1)) SELECT event_id, domain, granted, tokens FROM f WHERE n > 0"""
query("token_bucket", _BUCKET, _RECURSIVE)(lambda spark, sf: L.token_bucket(_paced(spark, sf), _limits(spark, sf)).where("event_id is not null").select("event_id", "domain", "granted", "tokens"))


@query("stream_token_bucket", _BUCKET, _RECURSIVE)
def _(spark, sf):
    at = scratch(spark)
    stream = L_log(_requests_stream(spark, sf)).withColumn("us", F.floor(F.col("us") / _PACE))
    return L.token_bucket_stream(stream, _limits(spark, sf), f"{at}/tables", f"{at}/checkpoint")


_BY_PRESET = _LIMITED + f""", p AS (SELECT event_id, domain, epoch_us(ts) // {_PACE} AS us FROM request_log), w AS (SELECT event_id, domain, {', '.join(f'count(*) OVER (PARTITION BY domain ORDER BY us RANGE BETWEEN {s}000000 PRECEDING AND CURRENT ROW) AS in_{s}s' for s in (1, 10, 60))},
us - lag(us) OVER (PARTITION BY domain ORDER BY us, event_id) AS gap_us FROM p) SELECT event_id, domain, in_1s, in_10s, in_60s, gap_us FROM w JOIN lim USING (domain) WHERE in_1s > rate OR in_10s > burst OR in_60s > 10 OR (regexp_extract(domain, '[0-9]+')::INT % 3 < 2 AND gap_us < delay * 1000000)"""
query("rate_violations_presets", _BY_PRESET)(lambda spark, sf: J.rate_violations(_paced(spark, sf).withColumn("ts", F.timestamp_micros("us")), limits=_limits(spark, sf)))


@query("stream_ingest")
def _(spark, sf):
    """The ingest job over a stream of pages: articles after the last batch."""
    pages, at = S.raw(spark, sf, "pages"), scratch(spark)
    state, _ = T.crawl_ingest(T.table_stream(spark, sf, "pages", pages.schema), _start(spark, sf), now(), f"{at}/tables", f"{at}/checkpoint", _robots(spark, sf))
    return state.articles.select("url", "content_hash", "crawled_at")


@query("stream_windowed_insights", "SELECT time_bucket(INTERVAL 1 DAY, started_at) AS start, count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 1) AS success_rate, count(*) FILTER (status = 'completed') * 100.0 / count(*) < 80 AS alert FROM crawl_jobs GROUP BY 1")
def _(spark, sf):
    jobs = T.event_time(_stream(spark, sf)).select("ts", (~F.col("event_type").isin("purchase", "error", "signup")).alias("completed"))
    return _plain(run_stream(T.job_alerts(jobs), "complete"), "start")


def _article_stream(spark, sf):
    """Articles as a stream of the documents; their time is that of the crawl."""
    return S.articles_of(T.table_stream(spark, sf, "documents", S.raw(spark, sf, "documents").schema)).withColumn("ts", F.col("crawled_at").cast("timestamp"))


@query("stream_insights", _INSIGHTS)
def _(spark, sf):
    """Insights behind the last batch of articles and jobs."""
    at, ago = scratch(spark), F.expr("interval 9 days")
    events = _stream(spark, sf)
    jobs = S.crawl_jobs_of(events).withColumn("started_at", F.col("started_at") + ago)
    figures = A.article_figures(_article_stream(spark, sf)).unionByName(A.job_figures(jobs))
    return T.insight_stream(figures, S.sources(spark, sf), now(), f"{at}/tables", f"{at}/checkpoint")


_WEEK = "time_bucket(INTERVAL 7 DAY, crawled_at, TIMESTAMP '1970-01-01')"
query("stream_category_windows", f"SELECT {_WEEK} AS start, category, count(*) AS articles FROM articles GROUP BY 1, 2")(lambda spark, sf: _plain(run_stream(T.category_windows(_article_stream(spark, sf).select("ts", "category")), "complete"), "start"))
query("stream_source_windows", f"SELECT {_WEEK} AS start, source_id, count(*) AS articles, round(avg(quality_score), 6) AS quality, count(*) < 10 OR avg(quality_score) < 0.4 AS underperforms FROM articles GROUP BY 1, 2")(lambda spark, sf: _plain(run_stream(T.source_windows(_article_stream(spark, sf).select("ts", "source_id", "quality_score")), "complete"), "start"))
