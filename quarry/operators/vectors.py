"""Vector search that prunes: product quantization with tables of partial products, then exact similarities of the best.

A unit vector is cut into stretches of PART numbers, and each is named by the nearest of at most 256 words of its codebook: a byte
for PART numbers. A query multiplies its stretches with the codebooks once; an article's similarity is then about the sum of one entry
a stretch. Only the ``candidates`` best of each query are compared exactly. Codebooks are fitted on a bounded sample, and
every vector is coded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores

from .filters import top_per_group

#: Vectors that codebooks are fitted on, at most, in the order of a hash; numbers of a stretch; words of a codebook.
SAMPLE, PART, WORDS = 20_000, 8, 256
#: Articles of a query that are compared exactly, and bytes of query tables that a broadcast may hold.
CANDIDATES, TABLE_BYTES = 150, 32 << 20
#: Articles and queries that a worker compares at a time.
ROWS, QUERIES = 1024, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1) / 2 - x @ words.T).argmin(1)


def fit_codebooks(articles: DataFrame, sample: int = SAMPLE, rounds: int = 12) -> list[np.ndarray]:
    """A codebook for each stretch, by k-means; a quarter as many words as there are vectors, at most WORDS."""
    some = articles.where("content_embedding is not null").select("id", "content_embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(some):
        return []
    x = _unit(np.stack(some["content_embedding"].to_numpy()).astype(np.float64))
    out = []
    for a in range(0, x.shape[1], PART):
        s = x[:, a : a + PART]
        words = s[: max(1, min(WORDS, len(s) // 4))].copy()
        for _ in range(rounds):
            of = _nearest(s, words)
            count = np.bincount(of, minlength=len(words))
            total = np.zeros_like(words)
            np.add.at(total, of, s)
            words[count > 0] = total[count > 0] / count[count > 0, None]
        out.append(words)
    return out


def encode(articles: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(id, code): the words of each vector, a byte a stretch; articles without a vector or with one of zeros only have no code."""
    kind = articles.schema["id"].dataType.simpleString()
    shared = articles.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            alive = np.flatnonzero(np.linalg.norm(x, axis=1) > 0) if len(x) else np.zeros(0, np.int64)
            x = _unit(x[alive])
            codes = np.stack([_nearest(x[:, k * PART : (k + 1) * PART], w) for k, w in enumerate(shared.value)], axis=1).astype(np.uint8) if len(alive) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    rows = articles.where("content_embedding is not null").select("id", F.col("content_embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {kind}, code binary")


def _best(ids: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest values of each row with their ids."""
    if values.shape[1] > count:
        at = np.argpartition(-values, count - 1, axis=1)[:, :count]
        ids, values = np.take_along_axis(ids, at, axis=1), np.take_along_axis(values, at, axis=1)
    return ids, values


def pq_search(queries: DataFrame, articles: DataFrame, limit: int = 10, candidates: int = CANDIDATES, codebooks: list[np.ndarray] | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity): about the ``limit`` nearest articles of each query, with exact similarities. ``codes`` is a stored
    ``encode`` of the articles with the same codebooks; without it they are coded on the way. Queries are a stated set and their
    tables travel in blocks of TABLE_BYTES; each task returns ``candidates`` rows a query at most. queries: query_id, embedding."""
    spark = articles.sparkSession
    codebooks = fit_codebooks(articles) if codebooks is None else codebooks
    kind = articles.schema["id"].dataType.simpleString()
    if not codebooks:
        return spark.createDataFrame([], f"query_id long, id {kind}, similarity double")
    codes = encode(articles, codebooks) if codes is None else codes
    entries = sum(map(len, codebooks))
    blocks = -(-queries.count() * entries * 4 // TABLE_BYTES) or 1
    near = None
    for k in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = block.where("embedding is not null").select(F.col("query_id").cast("long"), "embedding").collect()  # a block is bounded
        if not rows:
            continue
        q = _unit(np.array([r.embedding for r in rows], dtype=np.float64))
        tables = [(q[:, j * PART : (j + 1) * PART] @ w.T).astype(np.float32) for j, w in enumerate(codebooks)]
        part = _scan(codes, np.array([r.query_id for r in rows]), tables, candidates, kind)
        near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], f"query_id long, id {kind}, similarity double")
    near = top_per_group(near, ["query_id"], [F.desc("about"), F.asc("id")], candidates)
    exact = near.join(articles.select("id", "content_embedding"), "id").join(queries.select("query_id", "embedding"), "query_id")
    found = exact.select("query_id", "id", F.round(scores.cosine(F.col("embedding"), F.col("content_embedding")), 6).alias("similarity")).where("similarity is not null")
    return top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("id")], limit)


def _scan(codes: DataFrame, names: np.ndarray, tables: list[np.ndarray], candidates: int, kind: str) -> DataFrame:
    """(query_id, id, about): the best of each task by the sums of table entries."""
    shared = codes.sparkSession.sparkContext.broadcast((names, tables))

    def run(batches):
        ids_of, entries = shared.value
        ids, values = np.zeros((len(ids_of), 0), np.int64), np.zeros((len(ids_of), 0), np.float32)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                code = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
                names, parts = some.column(0).to_numpy(), []
                for b in range(0, len(ids_of), QUERIES):  # arrays of a few MB, whatever the number of queries
                    about = np.zeros((len(ids_of[b : b + QUERIES]), len(names)), np.float32)
                    for j, t in enumerate(entries):
                        about += t[b : b + QUERIES, code[:, j]]
                    here = np.broadcast_to(names, about.shape)
                    parts.append(_best(np.concatenate([ids[b : b + QUERIES], here], axis=1), np.concatenate([values[b : b + QUERIES], about], axis=1), candidates))
                ids, values = (np.concatenate(p) for p in zip(*parts))
        for b in range(0, len(ids_of), QUERIES):
            i = ids[b : b + QUERIES]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids_of[b : b + QUERIES], i.shape[1])), pa.array(i.ravel()), pa.array(values[b : b + QUERIES].ravel())], names=["query_id", "id", "about"])

    return codes.mapInArrow(run, f"query_id long, id {kind}, about float")
