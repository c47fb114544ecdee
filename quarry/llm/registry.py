"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them to the others."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, dualtree, htmlblocks, licenses, linededup, ngramjoin, periodic, pii, quality, substrings, tokencount, toxicity
from .chunks import prepare, read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word windows that start anywhere else, too."""
    prepare(spark)
    kept = substrings.repeated_substrings(read(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by anchor expansion."""
    prepare(spark)
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("pii"), pii.BASE), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes that they decode to."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state, by canonical digest."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    prepare(spark)
    return ngramjoin.jaccard_components(read(spark, sf_dir, "documents"), n=3, percent=90)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlblocks.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold within the edit budget."""
    prepare(spark)
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    prepare(spark)
    scored = toxicity.score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _repeated_tail(doc_id: Column, text: Column) -> Column:
    """Of every tenth document, by the crc32 of its id, a text whose words from one place on repeat a period; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n, words = F.floor(h / 10), F.size("_words"), F.col("_words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(moved, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, and the digest of the text without their repeated periods."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    asked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = docs.withColumn("_words", F.when(asked, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    found = periodic.find_runs(docs.select("doc_id", _repeated_tail(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.col("best")
    return found.select("doc_id", "runs", "kept_text", periodic.longest(F.col("runs")).alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["back"]).alias("start"), best["length"].alias("length"), (-best["small"]).alias("period"),
        F.floor(1000 * best["length"] / -best["small"]).alias("exponent_milli"), F.sha2(periodic.written(F.col("runs")), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    prepare(spark)
    return dualtree.search(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more documents hold, but for the one of largest doc_id."""
    kept = linededup.drop_repeated_lines(read(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_pii, op3_byte_bpe, op4_license_scan, op5_ngram_jaccard, op6_main_text, op7_decontamination, op8_token_counts, op9_toxicity, op10_quality_rules,
        op11_periodic_runs, op12_lexical_search, op13_line_dedup,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Base counts in DuckDB: lists of words and lines, windows numbered and grouped within a document.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
b AS (SELECT doc_id, t, l, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN n USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (10 * n_dup_lines > 6 * len(l))
       AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
       AND NOT (10 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 6 * word_chars) AS kept
FROM f
"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _op4_sql() -> str:
    plain = f"translate(lower(x), {_sql_text(licenses.PUNCTUATION)}, {_sql_text(' ' * len(licenses.PUNCTUATION))})"
    one = f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"
    for old, new in licenses.SPELLINGS:
        one = f"replace({one}, {_sql_text(old)}, {_sql_text(new)})"
    states = _sql_text(licenses.STATES)
    lines = f"list_filter(list_transform(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {one}), lambda x: CASE WHEN regexp_matches(x, {states}) THEN '' ELSE x END), lambda x: x <> '')"
    known = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in licenses.KNOWN)
    long = ", ".join(f"({_sql_text(i)}, {_sql_text(d)})" for i, _, _, d in licenses.PASSAGES)
    openings = ", ".join(f"({_sql_text(o)}, {n})" for o, n in dict.fromkeys((o, n) for _, o, n, _ in licenses.PASSAGES))
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256(list_aggregate({lines}, 'string_agg', ' ')) AS digest FROM (VALUES {known}) AS v(license_id, text) UNION VALUES {long}),
d AS (SELECT doc_id, {lines} AS l FROM documents), w AS (SELECT doc_id, list_aggregate(l, 'string_agg', ' ') AS t FROM d),
o AS (SELECT doc_id, t, size, opening, string_split(t, opening) AS parts FROM w, (VALUES {openings}) AS v(opening, size) WHERE contains(t, opening)),
q AS (SELECT doc_id, t, size, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(opening) + 1))::BIGINT AS pos FROM o),
u AS (SELECT doc_id, unnest(l) AS c, 'line' AS kind FROM d UNION ALL SELECT doc_id, t, 'whole' FROM w
      UNION ALL SELECT doc_id, substring(t, pos, size), 'passage' FROM q WHERE (pos = 1 OR substring(t, pos - 1, 1) = ' ') AND (length(t) = pos + size - 1 OR substring(t, pos + size, 1) = ' '))
SELECT doc_id, license_id, count(*) FILTER (WHERE kind = 'line') AS n_lines, count(*) FILTER (WHERE kind = 'passage') AS n_passages, bool_or(kind = 'whole') AS whole_text
FROM u JOIN known ON sha256(c) = digest GROUP BY doc_id, license_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Scores of all pairs of an item and a document that share a term.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
qt AS (SELECT q, item_id, t, count(*)::BIGINT AS k FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM s) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY t, docs),
c AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS c FROM tf JOIN s USING (r), g),
x AS (SELECT q, item_id, r, sum(k * w * c)::BIGINT AS score FROM qt JOIN w USING (t) JOIN c USING (t) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x JOIN s USING (r) WHERE score > 0) WHERE rank <= 10
"""

#: Keys of lines, how many rows hold each, and the lines that stay in their order.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
x AS (SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS gone FROM k LEFT JOIN m USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY r
"""

ORACLES: dict[str, str] = {"op4_license_scan": _op4_sql(), "op10_quality_rules": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_line_dedup": OP13_SQL}
