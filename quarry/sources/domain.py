"""The content tables, derived from the raw parquet tables.

Readers of the six relational tables (articles, sources, crawl_jobs, discovery_results, content_hashes,
system_metrics) and of the request log and response metadata. Each is a lazy projection of a raw table, so
filters and column pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores

#: The moment that time-relative queries stand at.
AS_OF = "2024-01-31 00:00:00"


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the scan has fewer splits than cores, as a small file of one row group has: work that takes far
    longer than the shuffle of such a table then runs on all of them. Any larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def articles(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """``heavy``: for work that takes long for each row (``spread``)."""
    d = raw(spark, sf, "documents")
    return articles_of(spread(d) if heavy else d)


def articles_of(d: DataFrame) -> DataFrame:
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 100)
    hours = ((F.col("doc_id") % 30) * 24 + F.col("doc_id") % 24).cast("int")
    out = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("content"), F.col("lang").alias("language"), title.alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), "doc_id").alias("url"),
        scores.content_hash(F.col("text")).alias("content_hash"),
        F.timestamp_add("HOUR", hours, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("crawled_at"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("author"), (F.col("doc_id") % 7).cast("string"))).alias("author"),
        F.when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>")).when(F.col("doc_id") % 4 != 0, F.array("lang", "source")).alias("tags"),
        F.md5("text").alias("etag"),
    )
    out = out.withColumn("published_at", F.when(F.col("id") % 5 != 0, F.col("crawled_at"))).withColumn("last_modified", F.col("crawled_at"))
    return out.withColumn("category", scores.detect_category(F.col("title"), F.substring("content", 1, 200))).withColumn("quality_score", scores.crawl_quality(F.col("content"), F.col("title"), F.col("author"), F.col("published_at")))


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "pages").select("page_id", "url", "html", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("domain"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    own = raw(spark, sf, "documents").select(F.col("source").alias("id")).distinct().withColumn("domain", F.concat("id", F.lit(".example.org")))
    hosts = page_hosts(spark, sf).select(F.col("domain").alias("id"), "domain").distinct()
    n = F.length("id")
    return own.unionByName(hosts).select(
        "id", F.col("id").alias("name"), F.concat(F.lit("https://"), "domain").alias("url"), "domain",
        scores.source_type(F.col("domain")).alias("source_type"), scores.detect_category(F.col("id"), F.col("domain")).alias("category"),
        (n % 5 != 0).alias("is_active"), F.when(n % 3 != 0, F.lit(0.5)).alias("trust_score"), scores.domain_reputation(F.col("domain")).alias("quality_score"),
        n.cast("long").alias("crawl_count"), (n % 3).cast("long").alias("error_count"), F.lit(3600).alias("crawl_frequency"),
        F.timestamp_add("DAY", -n, as_of()).alias("created_at"), F.when(n % 4 != 0, F.timestamp_add("HOUR", -n, as_of())).alias("last_crawled"),
    )


def sources_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with a later copy of every one whose id has an even length."""
    s = sources(spark, sf)
    copy = s.where(F.length("id") % 2 == 0).withColumn("id", F.concat("id", F.lit("-dup"))).withColumn("created_at", F.timestamp_add("DAY", F.lit(1), "created_at"))
    return s.unionByName(copy)


def articles_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Articles, some of them again under the copied source."""
    a = articles(spark, sf)
    again = a.where((F.col("id") % 50 == 0) & (F.length("source_id") % 2 == 0))
    return a.unionByName(again.withColumns({"id": F.col("id") + 1000000, "url": F.concat("url", F.lit("-dup")), "source_id": F.concat("source_id", F.lit("-dup"))}))


def crawl_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_jobs_of(raw(spark, sf, "events"))


def crawl_jobs_of(e: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("completed")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), status.alias("status"), F.col("ts").alias("started_at"))


def system_metrics(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("cpu_usage"), F.lit("memory_usage"), F.lit("disk_usage"))
    return raw(spark, sf, "events").select(F.col("event_id").alias("id"), F.get(names, (F.col("event_id") % 3).cast("int")).alias("metric_name"), F.least("value", F.lit(100.0)).alias("value"), F.col("ts").alias("recorded_at"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") != "error", 200).when(F.col("event_id") % 2 == 0, 500).otherwise(429)
    return raw(spark, sf, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit(".example.org")).alias("domain"), status.alias("status_code"), (F.col("value") / 100).alias("response_time"), "ts")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Search results by page: url, title and description of the page, engine and query."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return page_hosts(spark, sf).select(
        F.col("page_id").alias("seq"), "url", "domain", title.alias("title"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("tutorial "), title)).otherwise(F.lit("")).alias("description"),
        F.get(F.array(F.lit("google"), F.lit("bing"), F.lit("duckduckgo")), (F.col("page_id") % 3).cast("int")).alias("source_engine"), F.concat(F.lit("q"), (F.col("page_id") % 12).cast("string")).alias("search_query"),
    )


def discovery_results(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    text = F.concat_ws(" ", "title", "description")
    tech = scores.tech_relevance(F.col("title"), F.col("description"), F.col("domain"))
    return c.select(
        F.col("seq").alias("id"), "search_query", F.col("source_engine").alias("search_engine"), F.col("url").alias("discovered_url"), "domain", "title", "description",
        scores.relevance_score(text).alias("relevance_score"), scores.domain_reputation(F.col("domain")).alias("quality_score"), tech.alias("tech_relevance_score"),
        (tech >= 0.7).alias("is_tech_relevant"), (F.col("seq") % 7 == 0).alias("became_source"), F.timestamp_add("DAY", -(F.col("seq") % 60).cast("int"), as_of()).alias("discovered_at"),
    )


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.groupBy("content_hash").agg(
        F.min_by("id", F.struct("crawled_at", "id")).alias("first_article_id"), (F.count("*") - 1).alias("duplicate_count"), F.min("crawled_at").alias("first_seen_at"), F.max("crawled_at").alias("last_seen_at"), F.max(F.length("content")).cast("long").alias("content_length")
    )


def response_meta(spark: SparkSession, sf: str) -> DataFrame:
    """What a HEAD request to each source would have said."""
    n = F.length("id")
    headers = F.when(n % 2 == 0, F.create_map(F.lit("strict-transport-security"), F.lit("1"), F.lit("x-frame-options"), F.lit("DENY"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    return sources(spark, sf).select(
        "id", "domain", F.when(n % 4 == 0, 200).when(n % 4 == 1, 301).when(n % 4 == 2, 404).alias("https_status"), F.when(n % 3 == 0, 200).when(n % 3 == 1, 500).alias("http_status"), headers.alias("headers"),
        F.when(n % 2 == 1, F.timestamp_add("DAY", -n, as_of())).alias("last_modified"),
    )


def articles_emb(spark: SparkSession, sf: str) -> DataFrame:
    e = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("content_embedding"), F.col("label").alias("emb_category"))
    return articles(spark, sf).join(e, "id", "left")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_hits(text: str, weights) -> str:
    pairs = weights.items() if isinstance(weights, dict) else weights
    return "(" + " + ".join(f"CASE WHEN contains({text}, {_q(w)}) THEN {n} ELSE 0 END" for w, n in pairs) + ")"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def sql_category(title: str, description: str) -> str:
    from quarry.functions import fixed

    text = f"lower(coalesce({title}, '') || ' ' || coalesce({description}, ''))"
    return "CASE " + " ".join(f"WHEN {sql_any(text, w)} THEN {_q(k)}" for k, w in fixed.CATEGORIES.items()) + " ELSE 'general' END"


def sql_source_type(domain: str) -> str:
    from quarry.functions import fixed

    return "CASE " + " ".join(f"WHEN {sql_any(domain, w)} THEN {_q(k)}" for k, w in fixed.SOURCE_TYPES.items()) + " ELSE 'website' END"


def sql_clamp(points: str) -> str:
    return f"greatest(least({points}, 100), 0) / 100.0"


def sql_reputation(domain: str) -> str:
    from quarry.functions import fixed

    ends = " OR ".join(f"ends_with({domain}, {_q(s)})" for s in fixed.ACADEMIC)
    good = ", ".join(map(_q, fixed.GOOD_SUBDOMAINS))
    odd = " + ".join(f"CASE WHEN regexp_matches({domain}, {_q(p)}) THEN 10 ELSE 0 END" for p in fixed.SUSPICIOUS)
    return sql_clamp(f"50 + CASE WHEN {sql_any(domain, fixed.REPUTABLE)} THEN 30 ELSE 0 END + CASE WHEN {ends} THEN 20 ELSE 0 END + CASE WHEN len(string_split({domain}, '.')) <= 2 OR string_split({domain}, '.')[1] IN ({good}) THEN 10 ELSE 0 END - ({odd})")


def sql_crawl_quality(content: str, title: str, author: str, published: str) -> str:
    from quarry.functions import fixed

    return sql_clamp(f"50 + CASE WHEN length({content}) > 1000 THEN 10 ELSE 0 END + CASE WHEN length({title}) > 10 THEN 10 ELSE 0 END + CASE WHEN coalesce({author}, '') <> '' THEN 10 ELSE 0 END + CASE WHEN {published} IS NOT NULL THEN 10 ELSE 0 END + {sql_hits(f'lower({content})', [(w, 5) for w in fixed.CRAWL_WORDS])}")


def sql_tech_relevance(title: str, description: str, domain: str) -> str:
    from quarry.functions import fixed

    text = f"lower(coalesce({title}, '') || ' ' || coalesce({description}, ''))"
    bonus = "CASE " + " ".join(f"WHEN {domain} = {_q(d)} THEN {n}" for d, n in fixed.DOMAIN_BONUS.items()) + " ELSE 0 END"
    return sql_clamp(f"CASE WHEN {sql_any(text, fixed.RELEVANT_WORDS)} THEN 100 ELSE 0 END + {bonus}")


def sql_tokens(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda x: x <> '')"


def sql_keyword_score(text: str) -> str:
    from quarry.functions import fixed

    exact = " + ".join(f"CASE WHEN list_contains({sql_tokens(f'lower({text})')}, {_q(k)}) THEN {n // 2} ELSE 0 END" for k, n in fixed.TECH_WEIGHTS.items())
    return f"least(({sql_hits(f'lower({text})', fixed.TECH_WEIGHTS)} + {exact}) / 1000.0, 1.0)"


def sql_depth(text: str) -> str:
    from quarry.functions import fixed

    return f"least({sql_hits(f'lower({text})', fixed.DEPTH_WEIGHTS)} / 10.0 + least(length({text}) / 500.0, 0.3), 1.0)"


def sql_language(text: str) -> str:
    from quarry.functions import fixed

    return sql_clamp(f"80 - {sql_hits(f'lower({text})', [(w, 10) for w in fixed.CLICKBAIT])} + {sql_hits(f'lower({text})', [(w, 5) for w in fixed.TECHNICAL_TERMS])}")


def sql_structure(text: str) -> str:
    from quarry.functions import fixed

    return sql_clamp(f"50 + CASE WHEN length({text}) > 50 THEN 20 ELSE 0 END + CASE WHEN {sql_any(f'lower({text})', fixed.GUIDE_PHRASES)} THEN 10 ELSE 0 END")


def sql_relevance(text: str) -> str:
    return rf"CASE WHEN length(regexp_replace({text}, '^\s+|\s+$', '', 'g')) < 10 THEN 0.0 ELSE least({sql_keyword_score(text)} * 0.4::DOUBLE + {sql_depth(text)} * 0.3::DOUBLE + {sql_language(text)} * 0.2::DOUBLE + {sql_structure(text)} * 0.1::DOUBLE, 1.0) END"


NOW = f"TIMESTAMP '{AS_OF}'"


def prelude() -> str:
    """The same tables in SQL."""
    hash_ = r"sha256(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'))"
    cand = "SELECT page_id AS seq, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages"
    return rf"""WITH
a0 AS (SELECT doc_id AS id, source AS source_id, text AS content, lang AS language, substring(split_part(text, chr(10), 1), 1, 100) AS title,
  'https://' || source || '.example.org/' || lang || '/' || doc_id AS url, {hash_} AS content_hash,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id % 30) * 24 + doc_id % 24 AS INT)) AS crawled_at,
  CASE WHEN doc_id % 3 <> 0 THEN 'author' || (doc_id % 7) END AS author,
  CASE WHEN doc_id % 4 = 1 THEN [] WHEN doc_id % 4 <> 0 THEN [lang, source] END AS tags, md5(text) AS etag FROM documents),
a1 AS (SELECT *, CASE WHEN id % 5 <> 0 THEN crawled_at END AS published_at, crawled_at AS last_modified FROM a0),
articles AS (SELECT *, {sql_category('title', 'substring(content, 1, 200)')} AS category, {sql_crawl_quality('content', 'title', 'author', 'published_at')} AS quality_score FROM a1),
s0 AS (SELECT DISTINCT source AS id, source || '.example.org' AS domain FROM documents UNION ALL SELECT DISTINCT h, h FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages)),
sources AS (SELECT id, id AS name, 'https://' || domain AS url, domain, {sql_source_type('domain')} AS source_type, {sql_category('id', 'domain')} AS category,
  length(id) % 5 <> 0 AS is_active, CASE WHEN length(id) % 3 <> 0 THEN 0.5::DOUBLE END AS trust_score, {sql_reputation('domain')} AS quality_score,
  length(id)::BIGINT AS crawl_count, (length(id) % 3)::BIGINT AS error_count, 3600 AS crawl_frequency,
  {NOW} - to_days(length(id)::INT) AS created_at, CASE WHEN length(id) % 4 <> 0 THEN {NOW} - to_hours(length(id)) END AS last_crawled FROM s0),
sources_dup AS (SELECT * FROM sources UNION ALL SELECT * REPLACE (id || '-dup' AS id, created_at + INTERVAL 1 DAY AS created_at) FROM sources WHERE length(id) % 2 = 0),
articles_dup AS (SELECT * FROM articles UNION ALL SELECT * REPLACE (id + 1000000 AS id, url || '-dup' AS url, source_id || '-dup' AS source_id) FROM articles WHERE id % 50 = 0 AND length(source_id) % 2 = 0),
crawl_jobs AS (SELECT event_id AS id, 'src' || (user_id % 20) AS source_id, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status, ts AS started_at FROM events),
system_metrics AS (SELECT event_id AS id, ['cpu_usage', 'memory_usage', 'disk_usage'][event_id % 3 + 1] AS metric_name, least(value, 100) AS value, ts AS recorded_at FROM events),
request_log AS (SELECT event_id, 'src' || (user_id % 20) || '.example.org' AS domain, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 500 ELSE 429 END AS status_code, value / 100 AS response_time, ts FROM events),
c0 AS ({cand}),
candidates AS (SELECT seq, url, domain, title, CASE WHEN seq % 2 = 0 THEN 'tutorial ' || title ELSE '' END AS description, ['google', 'bing', 'duckduckgo'][seq % 3 + 1] AS source_engine, 'q' || (seq % 12) AS search_query FROM c0),
discovery_results AS (SELECT seq AS id, search_query, source_engine AS search_engine, url AS discovered_url, domain, title, description, {sql_relevance("(title || ' ' || description)")} AS relevance_score, {sql_reputation('domain')} AS quality_score,
  {sql_tech_relevance('title', 'description', 'domain')} AS tech_relevance_score, {sql_tech_relevance('title', 'description', 'domain')} >= 0.7 AS is_tech_relevant, seq % 7 = 0 AS became_source, {NOW} - to_days((seq % 60)::INT) AS discovered_at FROM candidates),
content_hashes AS (SELECT content_hash, arg_min(id, (crawled_at, id)) AS first_article_id, count(*) - 1 AS duplicate_count, min(crawled_at) AS first_seen_at, max(crawled_at) AS last_seen_at, max(length(content)) AS content_length FROM articles GROUP BY content_hash),
response_meta AS (SELECT id, domain, CASE length(id) % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 END AS https_status, CASE length(id) % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 END AS http_status, length(id) % 2 = 0 AS safe,
  CASE WHEN length(id) % 2 = 1 THEN {NOW} - to_days(length(id)::INT) END AS last_modified FROM sources),
articles_emb AS (SELECT a.*, e.embedding AS content_embedding, e.label AS emb_category FROM articles a LEFT JOIN embeddings e ON a.id = e.vec_id)
"""
