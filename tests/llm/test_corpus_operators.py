"""Operators on the whole corpus against brute force: n-gram join, substring deduplication, the pipeline."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import decontaminate, graph, ngramjoin, pii, quality, shared, substrings
from quarry.llm.shared import Tables

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def joined(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for g in s for j in having[g])
        for g in s:
            having[g].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_copies(seed, count=700):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") for _ in range(r.choice([4, 12, 30, 60, 90]))] for _ in range(25)]
    rows = []
    for i in range(count):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            b[r.randrange(len(b))] = r.choice("ABCxyz")
        if r.random() < 0.2:
            b = b[: r.randrange(1, len(b) + 1)]
        rows.append((i, " ".join(b)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a"), (2004, "A")]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 4096), (3, 90, 37), (5, 80, 4096)])
def test_ngram_join(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = near_copies(n * percent)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, id int").repartition(5)
    assert {tuple(x) for x in ngramjoin.jaccard_components(df, n=n, percent=percent).collect()} == joined(rows, n, percent)


def test_large_cluster_costs_its_size(spark, monkeypatch):
    """Near copies of one text over many blocks: few rows more than sets are dealt, and the components are those of all pairs."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 100)
    r = random.Random(11)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(120)]
    rows = []
    for i in range(1500):
        b = list(base)
        b[r.randrange(120)] = f"q{i}"
        if i % 100 == 7:  # some reach the rest only by way of a few others
            b[r.randrange(120)] = f"r{i}"
            b[r.randrange(120)] = f"s{i}"
        rows.append((i, " ".join(b)))
    dealt = []
    plain = ngramjoin._joined
    monkeypatch.setattr(ngramjoin, "_joined", lambda df, payload, join: (dealt.append((payload, df.count())), plain(df, payload, join))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(x) for x in ngramjoin.jaccard_components(df, n=3, percent=90).collect()} == joined(rows, 3, 90)
    whole = [n for payload, n in dealt if payload == "tokens"]
    assert whole[0] < 1.1 * 1500 and sum(whole) < 3 * 1500


def test_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = [(i, "one text that many rows share with each other") for i in range(200)] + [(i, f"own words of row {i} only stand here") for i in range(200, 230)] + [(300, rows_text := "a few share this text"), (301, rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(x) for x in ngramjoin.jaccard_components(df).collect()} == joined(rows, 3, 90)
    long = [(i, t + " x y z" * 20) for i, t in rows]
    assert sorted((tuple(x) for x in substrings.repeated_substrings(spark.createDataFrame(long, "doc_id long, text string")).collect()), key=str) == cut(long)


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (1, "A B C D"), (7, "other words stand here")], "doc_id long, text string")
    assert sorted(tuple(x) for x in ngramjoin.jaccard_components(df).collect()) == [(1, 2, 1), (3, 2, 1), (3, 2, 1), (7, 2, 7)]
    assert ngramjoin.jaccard_components(df.limit(0)).count() == 0


def test_tree_equals_pairs():
    import numpy as np

    r = random.Random(8)
    lists = [np.array(sorted(r.sample(range(40), r.randrange(1, 30)))) for _ in range(120)]
    for percent in (50, 80, 100):
        union = ngramjoin.tree_join([len(x) for x in lists], lists, percent)
        plain = ngramjoin.Union(len(lists))
        for a in range(len(lists)):
            for b in range(a):
                if len(np.intersect1d(lists[a], lists[b])) >= ngramjoin.need(len(lists[a]), len(lists[b]), percent):
                    plain.join(a, b)
        assert [union.find(k) for k in range(120)] == [plain.find(k) for k in range(120)]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    got = dict(tuple(x) for x in graph.components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect())
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: up[x] for x in up if any(x in e and e[0] != e[1] for e in edges)}


def cut(rows, window=35):
    ws = [words(t) for _, t in rows]
    seen = Counter(tuple(x[i : i + window]) for x in ws for i in range(len(x) - window + 1))
    out = []
    for (d, _), x in zip(rows, ws):
        keep = [True] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((d, len(x), keep.count(False), " ".join(a for a, k in zip(x, keep) if k)))
    return sorted(out, key=str)


def test_substrings(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "ñandú"]
    base = [[r.choice(vocabulary[: r.choice([2, 300])]) for _ in range(r.choice([4, 34, 35, 36, 90, 200]))] for _ in range(40)]
    rows = []
    for i in range(300):
        b = []
        for _ in range(r.randrange(1, 4)):
            x = list(r.choice(base))
            a = r.randrange(len(x))
            if r.random() < 0.5:
                x = x[a : a + r.choice([20, 35, 50, 100])]
            if r.random() < 0.3:
                x[r.randrange(len(x))] = f"zz{i}"
            b += x + [r.choice(vocabulary) for _ in range(r.choice([0, 3, 50]))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(b)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a " * 200), (9004, "a b " * 30), (5, rows[5][1]), (6, "other " + rows[7][1]), (9005, rows[9][1]), (9006, " ".join(f"q{k}" for k in range(80))), (None, "new start " + rows[11][1]), (None, rows[12][1]), (7, "one id with " + rows[13][1])]
    df = spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, place int, keys string").repartition(5)
    assert sorted((tuple(x) for x in substrings.repeated_substrings(df).collect()), key=str) == cut(rows)
    assert sorted((tuple(x) for x in substrings.repeated_substrings(df, window=5).collect()), key=str) == cut(rows, 5)
    assert substrings.repeated_substrings(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    t = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(t).where("kept").collect()}
    docs = [(i, x) for i, x in docs if i in kept]
    first = {i for i, _, c in joined(docs, 5, 80) if i == c}
    items = [(r.item_id, decontaminate.normalize(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    clean = [(i, x) for i, x in docs if i in first and not matcher.match(decontaminate.normalize(x))]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in clean)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    spans = {i: pii.find(x) for i, x in clean}
    found = next(i for i, s in spans.items() if s)
    stage = corpus_pipeline.redaction(spark, t, SF).where(f"doc_id = {found}").first()
    assert "[" + spans[found][0][0].upper() + "]" in stage.text and stage.n_chars == len(stage.text)
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, t.limit(0), SF).columns == t.columns


def turns(n, a, b):
    """The sequence of Thue and Morse, on which polynomials modulo a power of two agree with its complement."""
    return [(a, b)[bin(k).count("1") & 1] for k in range(n)]


def test_regular_words_and_texts_keep_apart(spark):
    one, two = "".join(turns(1024, "a", "b")), "".join(turns(1024, "b", "a"))
    shared = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*shared, one, "end"])), (2, " ".join([*shared, two, "end"])), (3, one), (4, two), (5, " ".join(turns(4096, "x", "y"))), (6, " ".join(turns(4096, "y", "x")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.repeated_substrings(df.where("doc_id < 3"), window=35).collect())) == [(1, 36, 0, rows[0][1]), (2, 36, 0, rows[1][1])]
    assert sorted(tuple(r) for r in substrings.repeated_substrings(df, window=35).collect()) == sorted(cut(rows))
    assert {tuple(r) for r in ngramjoin.jaccard_components(df, n=3, percent=90).collect()} == joined(rows, 3, 90)
    long = spark.createDataFrame([(1, one), (2, two), (3, "c" * 600), (4, "c" * 601), (5, "c" * 600)], "doc_id long, text string")
    assert {tuple(r)[::2] for r in ngramjoin.jaccard_components(long).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)}


def test_near_duplicates_of_the_pipeline_keep_texts_that_share_an_id(spark):
    import corpus_pipeline

    texts = {k: " ".join(f"{name}{j}" for j in range(30)) for k, name in enumerate(("one", "two", "three", "four"))}
    near = texts[1] + " end"
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, near), (9, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (5, None), (5, ""), (5, None), (6, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    seven = [t for d, t in got if d == 7]
    assert [x for x in got if x[0] != 7 and x[1] not in (near, texts[1])] == sorted([(9, texts[2]), (None, texts[3]), (5, None), (5, ""), (6, " ")], key=str)
    assert texts[0] in seven and sum(t in (near, texts[1]) for _, t in got) == 1
