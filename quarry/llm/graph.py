"""Connected components by alternating large and small stars; edges stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around: of all neighbours, the greater ones (large star); of the
    smaller neighbours and the node itself (small star). The minimum is aggregated map-side first and
    comes back by a join, so a node with many neighbours is never gathered."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    others = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that links reach, for every node of an edge. Edges are undirected. It reads one
    table, which ``tables.drop`` of the result removes."""
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = tables.keep(start, "edges")
    mark = None
    while True:
        after = tables.keep(_star(_star(now, True), False), "edges")
        tables.drop(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._quarry_path = now._quarry_path
    return out
