"""Joins, window operators and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed, scores

from .filters import top_per_group


def duplicate_domains(hashes: DataFrame, articles: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """Duplicates per domain, aggregated by source before the domain is joined."""
    per = hashes.join(articles.select(F.col("id").alias("first_article_id"), "source_id"), "first_article_id").groupBy("source_id").agg(F.count("*").alias("h"), F.sum("duplicate_count").alias("d"))
    out = per.join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id").groupBy("domain").agg(F.sum("h").alias("hash_count"), F.sum("d").alias("duplicate_count"))
    return out.orderBy(F.desc("duplicate_count"), "domain").limit(limit)


def known_domain_anti(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    return candidates.join(sources.where("is_active").select("domain"), "domain", "left_anti")


def new_discoveries_anti(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select("search_query", F.col("discovered_url").alias("url")), ["search_query", "url"], "left_anti")


def new_sources_anti(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with ``conflict``: the url is a source already."""
    return requests.join(sources.select("url", F.lit(True).alias("known")).distinct(), "url", "left").withColumn("conflict", F.col("known").isNotNull()).drop("known")


def exact_duplicates_semi(incoming: DataFrame, hashes: DataFrame) -> DataFrame:
    return incoming.join(hashes.select("content_hash"), "content_hash", "left_semi")


def length_band_pairs(probes: DataFrame, articles: DataFrame, now: Column, best: int = 50) -> DataFrame:
    """Pairs of a probe and a recent article of 0.7 to 1.3 times its length, the best by quality. Probes of one length have
    the same band, and of all articles in a band only the ``best`` and one more (a probe is no match of itself) can count. So the
    best are kept for each length, then for each stretch of 1, 2, 4, ... lengths; a band is made of a few such stretches, and no article meets a probe
    before. Ids, lengths and qualities are dealt first, so texts are read
    once: behind it Spark would compute a score again for each row."""
    order = [F.desc("quality_score"), F.asc("id")]
    a = articles.where(F.col("crawled_at") >= now - F.expr("interval 30 days")).where("content is not null").select("id", F.length("content").cast("long").alias("length"), "quality_score").repartition("id")
    level = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("length") + 1.0)).cast("int") + 1)).alias("level")  # longer stretches fit into no band
    held = top_per_group(a, ["length"], order, best + 1).select("id", "quality_score", "length", level).withColumn("stretch", F.floor(F.col("length") / F.pow(F.lit(2.0), "level")))
    held = top_per_group(held.drop("length"), ["level", "stretch"], order, best + 1)
    p = probes.where("content is not null").select(F.col("id").alias("probe_id"), F.length("content").cast("long").alias("probe_length"))
    size = F.col("probe_length").cast("double")
    bands = p.select("probe_length").distinct().select("probe_length", F.ceil(size * 0.7).cast("long").alias("low"), (F.floor(size * 1.3) + 1).cast("long").alias("high"))
    parts = []
    for k in range(33):
        x, y = -F.floor(-F.col("low") / 2.0**k), F.floor(F.col("high") / 2.0**k)  # the whole stretches of this length within the band are x to y - 1
        parts += [F.when((x < y) & (x % 2 == 1), F.struct(F.lit(k).alias("level"), x.alias("stretch"))), F.when((x < y) & (y % 2 == 1), F.struct(F.lit(k).alias("level"), (y - 1).alias("stretch")))]
    bands = bands.select("probe_length", F.explode(F.array_compact(F.array(*parts))).alias("s")).select("probe_length", "s.level", "s.stretch")
    found = top_per_group(bands.join(held, ["level", "stretch"]).drop("level", "stretch"), ["probe_length"], order, best + 1)
    pairs = p.join(found, "probe_length").where("id <> probe_id")
    return top_per_group(pairs, ["probe_id"], order, best).select("probe_id", "id", "quality_score")


def freshness_join(observed: DataFrame, articles: DataFrame) -> DataFrame:
    """Observed headers against the latest stored row of a url: is it unchanged?"""
    stored = latest_per_url(articles).select("url", F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"))
    same = (F.col("etag") == F.col("old_etag")) | (F.col("last_modified") == F.col("old_modified"))
    return observed.join(stored, "url", "left").select("url", F.coalesce(same, F.lit(False)).alias("is_fresh"))


def links_to_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    tech = scores.any_of(F.lower("domain"), fixed.TECH_DOMAIN_WORDS)
    return links.where(tech).join(sources.select("domain"), "domain", "left_anti")


def first_per_domain(candidates: DataFrame) -> DataFrame:
    return top_per_group(candidates, ["domain"], [F.asc("seq")], 1)


def oldest_per_url(sources: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without later copies, and articles without those of removed sources."""
    w = Window.partitionBy("url").orderBy("created_at", "id")
    ranked = sources.withColumn("_rank", F.row_number().over(w))
    gone = ranked.where("_rank > 1").select(F.col("id").alias("source_id"))
    return ranked.where("_rank = 1").drop("_rank"), articles.join(gone, "source_id", "left_anti")


def latest_per_url(articles: DataFrame) -> DataFrame:
    return top_per_group(articles, ["url"], [F.desc("crawled_at"), F.desc("id")], 1)


def rate_violations(log: DataFrame, per_second: int = 1, burst: int = 3, per_minute: int = 10, limits: DataFrame | None = None) -> DataFrame:
    """Requests with trailing counts of 1, 10 and 60 seconds and the gap since the one before; those over a limit. ``limits`` (domain, rate,
    burst, delay) are those of single domains, where a gap under the delay counts, too. Windows run
    within a minute of a domain, which holds the requests of the minute before, too, so a busy domain is dealt over many tasks;
    a gap over an empty minute is taken from the last request of the domain's minute before that has one. A request adds one where it is and takes it
    off where each span ends, so counts are running sums and a minute of many requests takes time in proportion."""
    minute = 60_000_000
    log = log.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("minute", F.floor(F.col("us") / minute))
    both = log.select("event_id", "domain", "us", "minute", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("at", F.col("minute") + F.col("later"))
    spans = (1, 10, 60)
    mark = lambda after, of, n: F.struct(F.lit(after).cast("long").alias("after"), *[F.lit(n if of in (None, s) else 0).cast("long").alias(f"d{s}") for s in spans])
    marks = F.explode(F.array(mark(0, None, 1), *[mark(s * 1_000_000 + 1, s, -1) for s in spans])).alias("m")
    marked = both.withColumn("m", marks).select("event_id", "domain", "minute", "later", "at", (F.col("us") + F.col("m.after")).alias("us"), F.when(F.col("m.after") == 0, F.col("us")).alias("own"), *[f"m.d{s}" for s in spans])
    marked = marked.where(F.col("us") < (F.col("at") + 1) * minute)
    place = Window.partitionBy("domain", "at")
    counts = {f"in_{s}s": F.sum(f"d{s}").over(place.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)) for s in spans}
    gap = F.col("us") - F.max("own").over(place.orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    own = marked.withColumn("gap_us", gap).withColumns(counts).where("later = 0 and own is not null")
    last = log.groupBy("domain", "minute").agg(F.max("us").alias("last"))
    last = last.select("domain", F.col("minute").alias("at"), F.lag("last").over(Window.partitionBy("domain").orderBy("minute")).alias("before"))
    out = own.join(last, ["domain", "at"]).withColumn("gap_us", F.coalesce("gap_us", F.col("us") - F.col("before")))
    over = (F.col("in_1s") > per_second) | (F.col("in_10s") > burst) | (F.col("in_60s") > per_minute)
    if limits is not None:
        out = out.join(limits.select("domain", "rate", F.col("burst").alias("most"), "delay"), "domain", "left")
        own = (F.col("in_1s") > F.col("rate")) | (F.col("in_10s") > F.col("most")) | (F.col("in_60s") > per_minute) | (F.col("gap_us") < F.col("delay") * 1_000_000)
        over = F.when(F.col("rate").isNull(), over).otherwise(own)
    return out.where(over).select("event_id", "domain", "in_1s", "in_10s", "in_60s", "gap_us")


def candidate_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def url_frontier(home: DataFrame, sitemap: DataFrame, feed: DataFrame, links: DataFrame, max_urls: int) -> DataFrame:
    """Urls per source: home, at most half from the sitemap, a quarter from feeds, then links; distinct and
    at most ``max_urls``. Each part: source_id, url, seq."""
    shares = [(home, 0, 1), (sitemap, 1, max_urls // 2), (feed, 2, max_urls // 4), (links, 3, max_urls)]
    parts = [top_per_group(p, ["source_id"], [F.asc("seq"), F.asc("url")], n).withColumn("origin", F.lit(k)) for p, k, n in shares]
    once = top_per_group(candidate_union(*parts), ["source_id", "url"], [F.asc("origin"), F.asc("seq")], 1)
    return top_per_group(once, ["source_id"], [F.asc("origin"), F.asc("seq"), F.asc("url")], max_urls)


def query_pool(base: DataFrame, successes: DataFrame, year: int, limit: int = 20) -> DataFrame:
    """Distinct queries: base, trending, trending of the year, the first five of base with each modifier, and past
    successes; in alphabetical order, as a draw would not repeat. base: query; its first ones are the least."""
    spark = base.sparkSession
    trend = spark.createDataFrame([(k, t) for k, t in enumerate(fixed.TRENDING)], "seq int, query string")
    dated = trend.where("seq < 5").select(F.concat("query", F.lit(f" {year}")).alias("query"))
    both = base.orderBy("query").limit(5).select(F.explode(F.array(*[F.concat("query", F.lit(f" {m}")) for m in fixed.MODIFIERS])).alias("query"))
    every = candidate_union(base.select("query"), trend.select("query"), dated, both, successes.select("query")).distinct()
    return every.orderBy("query").limit(limit)


def suggestions(articles: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Distinct titles and tags that contain the text, from the best articles that do."""
    from .filters import tag_or_title_match

    best = tag_or_title_match(articles, text).orderBy(F.desc("quality_score"), "id").limit(2 * limit)
    words = best.select(F.explode(F.concat(F.array("title"), F.coalesce("tags", F.array().cast("array<string>")))).alias("suggestion"))
    return words.where(F.contains(F.lower("suggestion"), F.lit(text.lower()))).distinct().orderBy("suggestion").limit(limit)


def keyword_token_set(text: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(scores.tokens(F.lower(text))), F.array(*[F.lit(k) for k in fixed.TECH_WEIGHTS])))
