"""The six relational tables by declared schema, from files or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Columns of each table, with the column by which rows are dealt when it is read from a database.
SCHEMAS: dict[str, tuple[str, str]] = {
    "sources": ("id string, name string, url string, domain string, source_type string, category string, is_active boolean, trust_score double, quality_score double, crawl_frequency int, crawl_count long, error_count long, created_at timestamp_ntz, last_crawled timestamp_ntz", "created_at"),
    "articles": ("id long, source_id string, url string, title string, content string, content_hash string, language string, category string, author string, tags array<string>, quality_score double, published_at timestamp_ntz, crawled_at timestamp_ntz, etag string, last_modified timestamp_ntz", "id"),
    "crawl_jobs": ("id long, source_id string, status string, started_at timestamp_ntz", "id"),
    "discovery_results": ("id long, search_query string, search_engine string, discovered_url string, domain string, title string, description string, relevance_score double, quality_score double, tech_relevance_score double, is_tech_relevant boolean, became_source boolean, discovered_at timestamp_ntz", "id"),
    "content_hashes": ("content_hash string, first_article_id long, duplicate_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, content_length long", "first_article_id"),
    "system_metrics": ("id long, metric_name string, value double, recorded_at timestamp_ntz", "id"),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table][0])


def read_files(spark: SparkSession, table: str, path: str, kind: str = "parquet") -> DataFrame:
    """A table from files, without a pass to infer its schema; columns that the files lack are null."""
    return spark.read.schema(schema(table)).format(kind).load(path)


def jdbc_options(table: str, url: str, lower: str, upper: str, parts: int, fetch: int = 10_000, **more: str) -> dict[str, str]:
    """Options of a read in ``parts`` ranges of the table's key, each by a task of its own; ``lower`` and ``upper`` only set where
    ranges lie, no row is left out."""
    if parts < 1:
        raise ValueError("at least one part")
    key = SCHEMAS[table][1]
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": str(parts), "fetchsize": str(fetch), **more}


def read_database(spark: SparkSession, table: str, url: str, lower: str, upper: str, parts: int, **more: str) -> DataFrame:
    """A table from a database whose JDBC driver the cluster has; filters and columns reach the database. Columns are read as they are
    declared, since a cast (of VARCHAR to string) would keep a filter out of the database."""
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(table) if not isinstance(f.dataType, ArrayType))
    options = jdbc_options(table, url, lower, upper, parts, **{"customSchema": plain, "preferTimestampNTZ": "true", **more})
    df = spark.read.format("jdbc").options(**options).load()
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*[F.col(f.name) if have[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table)])
