"""Vector search by codes against a full search."""

import random

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import scores
from quarry.operators import similarity, vectors
from quarry.operators.filters import top_per_group


@pytest.mark.parametrize(("sf", "candidates"), [("sf0.1", vectors.CANDIDATES), ("sf0.01", 60)])
def test_recall_and_work(spark, sf, candidates):
    """Recall of the ten nearest of ids divisible by 50 among all, for a fifth of the exact work where there are thousands."""
    sf = f"/root/testdata/{sf}"
    queries, articles = catalog._queries(spark, sf), catalog.S.articles_emb(spark, sf)
    exact = {(r.query_id, r.id) for r in similarity.cosine_pairs(queries, articles, -2.0, 10).collect()}
    rows = vectors.pq_search(queries, articles, candidates=candidates).collect()
    assert len(rows) == len(exact) and len(exact & {(r.query_id, r.id) for r in rows}) >= 0.95 * len(exact)
    n = articles.where("content_embedding is not null").count()
    if sf.endswith("0.1"):
        assert 1 / vectors.PART + candidates / n <= 0.2


def test_all_candidates_make_it_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TABLE_BYTES", 20_000)  # several blocks of queries
    sf = "/root/testdata/sf0.01"
    queries, articles = catalog._queries(spark, sf), catalog.S.articles_emb(spark, sf)
    want = sorted(tuple(r) for r in similarity.cosine_pairs(queries, articles, -2.0, 10).collect())
    books = vectors.fit_codebooks(articles)
    assert sorted(tuple(r) for r in vectors.pq_search(queries, articles, candidates=10_000, codebooks=books, codes=vectors.encode(articles, books)).collect()) == want


def test_pieces_of_articles_and_queries(spark, monkeypatch):
    """Searching in pieces of any size finds the same."""
    sf = "/root/testdata/sf0.01"
    queries, articles = catalog._queries(spark, sf), catalog.S.articles_emb(spark, sf)
    books = vectors.fit_codebooks(articles)
    found = []
    for size in (1 << 20, 7):
        monkeypatch.setattr(vectors, "ROWS", size)
        monkeypatch.setattr(vectors, "QUERIES", size)
        found.append(sorted(tuple(r) for r in vectors.pq_search(queries, articles, candidates=200, codebooks=books).collect()))
    assert found[0] == found[1] != []


def test_edges(spark):
    r = random.Random(1)
    rows = [(k, [r.random() - 0.5 for _ in range(11)]) for k in range(30)] + [(50, None), (51, [0.0] * 11), (52, [1.0] * 11), (53, [1.0] * 11)]
    a = spark.createDataFrame(rows, "id long, content_embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0] * 11), (2, None)], "query_id long, embedding array<double>")
    got = [tuple(x) for x in vectors.pq_search(q, a, limit=2).orderBy("id").collect()]
    assert got == [(1, 52, 1.0), (1, 53, 1.0)]
    assert vectors.encode(a, vectors.fit_codebooks(a)).count() == 32
    assert vectors.pq_search(q, a.limit(0)).collect() == vectors.pq_search(q.limit(0), a).collect() == []


@pytest.mark.parametrize(("limit", "block"), [(None, 32 << 20), (3, 32 << 20), (3, 300), (0, 32 << 20)])
def test_multiplied_pairs(spark, monkeypatch, limit, block):
    """Every pair over the threshold or the best of each query, copies and odd vectors included; vectors meet in no join."""
    monkeypatch.setattr(similarity, "QUERY_BYTES", block)
    r = random.Random(2)
    rows = [(k, [float(r.randrange(-3, 4)) for _ in range(5)]) for k in range(700)] + [(1000, None), (1001, [0.0] * 5), (1002, [1.0] * 4), (1003, [1.0, None, 1.0, 1.0, 1.0])]
    a = spark.createDataFrame(rows, "id long, content_embedding array<float>").repartition(3)
    q = a.where("id % 50 = 0 or id > 999").select(F.col("id").alias("query_id"), F.col("content_embedding").alias("embedding"))
    found = similarity.cosine_pairs(q, a, 0.5, limit)
    both = q.crossJoin(a.where("content_embedding is not null")).select("query_id", "id", F.round(scores.cosine(F.col("embedding"), F.col("content_embedding")), 6).alias("similarity")).where("similarity >= 0.5")
    want = both if limit is None else top_per_group(both, ["query_id"], [F.desc("similarity"), F.asc("id")], limit)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("cell", [1, 16])
def test_nearest_of_each_with_copies(spark, monkeypatch, cell):
    """Equal similarities, zero vectors and small groups, in one cell or many; vectors travel as they are stored."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 9)
    monkeypatch.setattr(similarity, "CELL", cell)
    r = random.Random(3)
    rows = [(k, "ab"[k % 2], [float(r.randrange(-2, 3)) for _ in range(3)]) for k in range(80)] + [(100 + k, "b", [1.0, 1.0, 1.0]) for k in range(9)] + [(200, "c", [1.0, 0.0, 0.0]), (201, "c", [0.0] * 3), (202, "d", [1.0, 0.0, 0.0])]
    a = spark.createDataFrame(rows, "id long, category string, content_embedding array<float>").repartition(3)
    found = similarity.similar_per_article(a)
    b = a.select(F.col("id").alias("other_id"), "category", F.col("content_embedding").alias("v"))
    both = a.join(b, "category").where("id <> other_id").select("id", "other_id", F.round(scores.cosine(F.col("content_embedding"), F.col("v")), 6).alias("similarity"))
    want = top_per_group(both, ["id"], [F.desc("similarity"), F.asc("other_id")], 5)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString()
