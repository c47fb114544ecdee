"""Line deduplication, in DataFrame functions alone.

A text is split at ``\\n``. The key of a line is the line without blanks and ``\\t\\n\\x0b\\x0c\\r`` at both ends, A to Z in
lower case. Lines whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more go,
except in the largest doc_id that holds the key, where all of them stay.

1. Each document's distinct keys are exploded and hashed (128 bits); Spark counts documents by hash, map-side first, and
   keeps the keys that reach the threshold with the doc_id that keeps them.
2. Lines are exploded with their positions, hashed and joined to those keys; a frequent key is dealt over many tasks.
3. The positions to drop are gathered by document, whose own length bounds them, and the text is put together again
   from the positions that stay. Only here do texts travel.

A null or empty text is one empty line. Each row is a document, also a repeated one. Rows that tie for the largest doc_id all
keep their lines; a row without doc_id comes below all others, and if no row that holds a key has one, the key's lines stay.
Very long texts are split whole. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, join_few

#: Parts over which rows without doc_id are dealt, and frequent keys that may be broadcast (some 40 bytes each).
PARTS, MOST_HOT = 256, 100_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    # ``lower`` does the same for ASCII and is faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, SMALL))


def _hashed(lines: DataFrame, min_chars: int) -> DataFrame:
    """Lines or keys in ``key`` as two 64-bit hashes; those under ``min_chars`` go."""
    rest = [c for c in lines.columns if c != "key"]
    return lines.where(F.length("key") >= min_chars).select(*rest, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.col(doc_id).cast("long")
    # k1 and k2 name a row by its doc_id and text. Only rows without doc_id may be many of one name: ``part`` deals them out.
    source = docs.select(own.alias("doc_id"), body.alias("text"), F.coalesce(own, F.xxhash64(body)).alias("k1"), F.xxhash64(body).alias("k2"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("short").alias("part"))
    split = F.split("text", "\n", -1)
    distinct = source.select("doc_id", F.explode(F.array_distinct(F.transform(split, line_key))).alias("key"))
    counts = _hashed(distinct, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.max("doc_id").alias("keeper"))
    tables = Tables(docs.sparkSession)
    repeated = tables.keep(counts.where(F.col("copies") >= min_docs), "keys")
    lines = source.select("doc_id", "k1", "k2", "part", F.posexplode(split).alias("pos", "line")).select("doc_id", "k1", "k2", "part", "pos", line_key(F.col("line")).alias("key"))
    marked = join_few(_hashed(lines, min_chars), repeated, ["h1", "h2"], "part", MOST_HOT)
    gone = marked.where(F.col("copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"), F.bool_and(F.col("doc_id").isNull()).alias("unnamed"))
    drops = tables.keep(drops, "drops")
    tables.drop(repeated)
    every = F.when(F.col("unnamed"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))).cast("array<short>")
    dealt = source.withColumn("part", F.when(F.col("doc_id").isNull(), F.col("part")).otherwise(F.lit(0).cast("short")))
    ready = dealt.join(drops.select("k1", "k2", "drop", F.explode(every).alias("part")), ["k1", "k2", "part"], "left").select("doc_id", "text", "drop", split.alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.element_at("lines", i + 1)))
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return ready.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
