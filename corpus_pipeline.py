"""Corpus cleaning pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes what a stage returns as Parquet and reads it again for the next one.
Stages keep every document that they have no reason to drop; null texts fail the quality rules. Columns other than those of
``documents`` are left behind; empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, ngramjoin, pii, quality
from quarry.llm.chunks import prepare
from quarry.llm.shared import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.apply_rules(docs).where("rejected_by is null").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that links of 0.8 or more 5-word Jaccard similarity make; of equal rows one
    stays. Rows are told apart by doc_id and text: those without doc_id, and further texts of a doc_id, stand behind all
    others in an order of their hashes. Texts without words are linked with nothing and stay."""
    prepare(spark)
    own, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    docs = docs.select(COLUMNS).withColumn("_text", text)
    # A doc_id of several texts belongs to that of least hash.
    several = docs.groupBy(own.alias("_id")).agg(F.min("_text").alias("_first"), F.max("_text").alias("_last")).where("_id is not null and _first < _last").select("_id", "_first")
    several = Tables(spark).keep(several, "several")  # hardly any: as a table Spark knows its size and does not deal the texts for it
    docs = docs.join(several, own == F.col("_id"), "left")
    named = F.lit(1 << 62).bitwiseOR(F.xxhash64("_text", own).bitwiseAND(F.lit((1 << 62) - 1)))
    docs = docs.withColumn("_row", F.when(own.isNull() | (F.col("_text") != F.col("_first")), named).otherwise(own)).select(*COLUMNS, "_row")
    groups = ngramjoin.jaccard_components(docs, n=5, percent=80, doc_id="_row")
    first = groups.where("component_id = doc_id").select(F.col("doc_id").alias("_row"))
    return docs.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget; null and empty texts hold none, each row is judged for itself."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, where spans tie or overlap as ``pii.find_pii`` orders them; null texts stay null."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again; null and empty texts have none. Repeated rows stay."""
    prepare(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", redaction),
    ("byte-level BPE", encoding),
]

#: SQL expresses none of the last four stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            tables.drop(before)  # no later stage reads it
        before = docs
    return docs
