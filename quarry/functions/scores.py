"""Scorers and classifiers as native Column expressions.

Scores are summed in whole hundredths and divided once, so they are the same in any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def hits(text: Column, weights: dict[str, int] | list[str], each: int = 1) -> Column:
    """Sum of the weights of the words that the text contains as substrings."""
    pairs = weights.items() if isinstance(weights, dict) else ((w, each) for w in weights)
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), F.lit(n)).otherwise(F.lit(0)) for w, n in pairs])


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def clamp(hundredths: Column) -> Column:
    """Hundredths to a score between 0 and 1."""
    return F.greatest(F.least(hundredths, F.lit(100)), F.lit(0)) / F.lit(100.0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text stripped, in lower case, white space collapsed."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), r"\s+", " "), 256)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def structure_hash(text: Column) -> Column:
    """MD5 of the sorted distinct words of over 3 characters, sampled at the start, middle and end when there are over 50."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        some = F.concat(F.slice(w, 1, 20), F.slice(w, F.floor(n / 2).cast("int") - 9, 20), F.slice(w, -20, 20))
        return F.md5(F.array_join(F.array_sort(F.array_distinct(F.when(n > 50, some).otherwise(w))), " "))

    return F.transform(F.array(F.filter(tokens(text), lambda x: F.length(x) > 3)), hashed)[0]


def normalize(text: Column, mode: str = "reference") -> Column:
    """Lower case, stripped; ``intended`` also collapses white space and drops punctuation."""
    if mode == "intended":
        text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[.,;:!?()\[\]{}\"']", "")
    return strip(F.lower(text))


def crawl_quality(content: Column, title: Column, author: Column, published: Column) -> Column:
    words = hits(F.lower(content), fixed.CRAWL_WORDS, 5)
    points = F.lit(50) + F.when(F.length(content) > 1000, 10).otherwise(0) + F.when(F.length(title) > 10, 10).otherwise(0)
    points += F.when(F.coalesce(author, F.lit("")) != "", 10).otherwise(0) + F.when(published.isNotNull(), 10).otherwise(0)
    return clamp(points + words)


def extraction_quality(content: Column, title: Column, author: Column, published: Column, tags: Column) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    points = F.when(F.coalesce(title, F.lit("")) != "", 20).otherwise(0) + F.when(F.length(content) > 500, 30).otherwise(0)
    points += F.when(F.coalesce(author, F.lit("")) != "", 10).otherwise(0) + F.when(published.isNotNull(), 10).otherwise(0)
    points += F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, 10).otherwise(0)
    return clamp(points + F.least(hits(low, fixed.EXTRACT_WORDS, 5), F.lit(20)))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def detect_language(text: Column, default: str = "en") -> Column:
    """The language with most function words in the first 1000 characters; ties in the order of the list."""

    def known(w: Column, language: str) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*fixed.STOP_WORDS[language])))

    def best(w: Column) -> Column:
        counts = {k: known(w, k) for k in fixed.LANGUAGES}
        top = F.greatest(*counts.values())
        out = F.when(top == 0, F.lit(default))
        for k, n in counts.items():
            out = out.when(n == top, F.lit(k))
        return out

    return F.transform(F.array(tokens(F.lower(F.substring(text, 1, 1000)))), best)[0]


def hash_embedding(text: Column, size: int = 1536) -> Column:
    """The 16 bytes of the MD5, scaled to -0.5..0.5, repeated to ``size`` numbers."""
    digest = F.md5(text)
    sixteen = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)
    return F.slice(F.flatten(F.array_repeat(sixteen, -(-size // 16))), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of numbers; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# The scores below name the lowered text and its words many times. Spark computes an expression that is always evaluated once
# for all its uses, so none of them may stand in a branch.


def _keywords(low: Column) -> Column:
    whole = F.array_intersect(F.array(*[F.lit(k) for k in fixed.TECH_WEIGHTS]), tokens(low))
    again = reduce(lambda a, b: a + b, [F.when(F.array_contains(whole, k), F.lit(n // 2)).otherwise(F.lit(0)) for k, n in fixed.TECH_WEIGHTS.items()])
    return F.least((hits(low, fixed.TECH_WEIGHTS) + again) / 1000.0, F.lit(1.0))


def _depth(low: Column, size: Column) -> Column:
    return F.least(hits(low, fixed.DEPTH_WEIGHTS) / 10.0 + F.least(size / 500.0, F.lit(0.3)), F.lit(1.0))


def _language(low: Column) -> Column:
    return clamp(F.lit(80) - hits(low, fixed.CLICKBAIT, 10) + hits(low, fixed.TECHNICAL_TERMS, 5))


def _structure(low: Column, size: Column) -> Column:
    return clamp(F.lit(50) + F.when(size > 50, 20).otherwise(0) + F.when(any_of(low, fixed.GUIDE_PHRASES), 10).otherwise(0))


def tech_keyword_score(text: Column) -> Column:
    """Weighted substrings, and half the weight again for whole words, over the sum of ten full weights."""
    return _keywords(F.lower(text))


def content_depth_score(text: Column) -> Column:
    return _depth(F.lower(text), F.length(text))


def language_quality_score(text: Column) -> Column:
    return _language(F.lower(text))


def structure_score(text: Column) -> Column:
    return _structure(F.lower(text), F.length(text))


def relevance_score(text: Column) -> Column:
    """The blend of the four scores; 0 for fewer than 10 characters."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    blend = F.least(_keywords(low) * 0.4 + _depth(low, F.length(text)) * 0.3 + _language(low) * 0.2 + _structure(low, F.length(text)) * 0.1, F.lit(1.0))
    return blend * F.when(F.length(strip(text)) < 10, F.lit(0.0)).otherwise(F.lit(1.0))


def _contained(low: Column, words) -> Column:
    return F.array_remove(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)).otherwise(F.lit("")) for k in words]), "")


def keyword_matches(text: Column) -> Column:
    return _contained(F.lower(text), fixed.TECH_WEIGHTS)


def explain_relevance(text: Column) -> Column:
    found = _contained(F.lower(text), fixed.DEPTH_WEIGHTS)
    parts = [tech_keyword_score(text).alias("tech_keywords_score"), content_depth_score(text).alias("content_depth_score"), language_quality_score(text).alias("language_quality_score"), structure_score(text).alias("structure_score")]
    overall = F.least(sum(p * w for p, w in zip(parts, (0.4, 0.3, 0.2, 0.1))), F.lit(1.0))
    return F.struct(overall.alias("overall_score"), keyword_matches(text).alias("tech_keywords_found"), found.alias("quality_indicators_found"), F.length(text).alias("text_length"), *parts)


def tech_relevance(title: Column, description: Column, domain: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    bonus = F.lit(0)
    for d, n in fixed.DOMAIN_BONUS.items():
        bonus = F.when(domain == d, F.lit(n)).otherwise(bonus)
    return clamp(F.when(any_of(text, fixed.RELEVANT_WORDS), 100).otherwise(0) + bonus)


def domain_reputation(domain: Column) -> Column:
    points = F.lit(50) + F.when(any_of(domain, fixed.REPUTABLE), 30).otherwise(0)
    points += F.when(reduce(lambda a, b: a | b, [F.endswith(domain, F.lit(s)) for s in fixed.ACADEMIC]), 20).otherwise(0)
    parts = F.split(domain, r"\.")
    points += F.when((F.size(parts) <= 2) | parts[0].isin(*fixed.GOOD_SUBDOMAINS), 10).otherwise(0)
    for pattern in fixed.SUSPICIOUS:
        points -= F.when(domain.rlike(pattern), 10).otherwise(0)
    return clamp(points)


def html_quality(html: Column) -> Column:
    low = F.lower(html)
    points = F.lit(50) + hits(low, fixed.PAGE_INDICATORS, 5)
    points += F.when(F.contains(html, F.lit("<title>")) & F.contains(html, F.lit("</title>")), 10).otherwise(0)
    points += F.when(F.contains(html, F.lit('<meta name="description"')), 10).otherwise(0)
    for pattern in fixed.PAGE_PATTERNS:
        points += F.when(html.rlike("(?i)" + pattern), 5).otherwise(0)
    points -= hits(low, fixed.PAGE_SPAM, 5)
    return points + F.when(F.length(html) > 5000, 10).when(F.length(html) < 1000, -10).otherwise(0)


def page_score(html: Column, https_status: Column, http_status: Column) -> Column:
    """HTML quality of what the site serves: neutral for another status, less over plain HTTP, low when out of reach."""
    points = F.when(https_status.isNotNull(), F.when(https_status == 200, html_quality(html)).otherwise(50))
    points = points.when(http_status.isNotNull(), F.when(http_status == 200, html_quality(html) - 10).otherwise(50)).otherwise(30)
    return clamp(points)


def source_type(domain: Column) -> Column:
    out = F
    for kind, words in fixed.SOURCE_TYPES.items():
        out = out.when(any_of(domain, words), F.lit(kind))
    return out.otherwise(F.lit("website"))


def detect_category(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F
    for name, words in fixed.CATEGORIES.items():
        out = out.when(any_of(text, words), F.lit(name))
    return out.otherwise(F.lit("general"))


def technical_indicators(https_status: Column, http_status: Column, headers: Column) -> Column:
    """Thousandths, as a security header counts 0.025."""
    safe = reduce(lambda a, b: a + b, [F.when(F.map_contains_key(headers, h), 25).otherwise(0) for h in fixed.SECURITY_HEADERS])
    secure = F.lit(500) + F.when(https_status == 200, 200).when(https_status.isin(301, 302), 100).otherwise(-200) + safe + 100
    plain = F.when(http_status.isNull(), 100).when(http_status == 200, 600).otherwise(200)
    points = F.when(https_status.isNotNull(), secure).otherwise(plain)
    return F.greatest(F.least(points, F.lit(1000)), F.lit(0)) / F.lit(1000.0)


def mean_of(*scores: Column) -> Column:
    """Mean of the scores that are there, 0.5 without any."""
    known = F.array_compact(F.array(*scores))
    return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)), F.lit(0.5))


def growth_rate(total: Column, recent: Column) -> Column:
    return F.round(recent / F.greatest(total, F.lit(1)) * 100, 1)


def performance_score(total: Column, quality: Column, recent: Column, trust: Column) -> Column:
    volume = F.when(total > 100, 30).when(total > 50, 20).when(total > 10, 10).otherwise(0)
    activity = F.when(recent > 10, 20).when(recent > 5, 15).when(recent > 0, 10).otherwise(0)
    return F.round(F.least(volume + F.coalesce(quality, F.lit(0.0)) * 40 + activity + F.coalesce(trust, F.lit(0.0)) * 10, F.lit(100.0)), 1)


def health_score(cpu: Column, memory: Column, disk: Column, rows: Column) -> Column:
    """The score before it is cut at 0."""
    off = F.when(cpu > 80, 20).when(cpu > 60, 10).otherwise(0) + F.when(memory > 90, 20).when(memory > 70, 10).otherwise(0) + F.when(disk > 90, 30).when(disk > 80, 15).otherwise(0)
    return F.lit(100) - F.when(rows > 0, off).otherwise(10)


def health_status(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "warning").otherwise("critical")


def update_type(similarity: Column) -> Column:
    return F.when(similarity > 0.95, "minor_edit").when(similarity > 0.8, "content_update").when(similarity > 0.5, "major_revision").otherwise("complete_rewrite")


def parse_date(text: Column) -> Column:
    """The first of six formats that fits: ISO with offset, ISO with Z, date and time, date, d/m/Y, m/d/Y."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
