"""Runs, ranked search and line deduplication against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import dualtree, linededup, periodic, registry
from quarry.llm.shared import Tables

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def all_runs(w, least=12):
    """Every stretch that each period makes, with the least period of the stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = [a == b for a, b in zip(w, w[q:])] + [False]
        i = 0
        while i < len(same):
            if same[i]:
                j = i
                while same[j]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    out.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_runs_of_random_words():
    r = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(r.randrange(1, 5)):
            n, k = r.choice([0, 5, 12, 40, 150]), r.choice([1, 2, 3, 20])
            d = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a, p = r.randrange(n), r.randrange(1, max(2, n // 3))
                d = [d[i] if i < a else d[min(n - 1, a + (i - a) % p)] for i in range(n)]
            if n and r.random() < 0.3:
                d = (d[: r.randrange(1, n + 1)] + [99]) * r.randrange(1, 5)
            texts.append(d)
        first = np.cumsum([0, *map(len, texts)])
        flat = np.array([1000 * k + x for k, d in enumerate(texts) for x in d], dtype=np.int64)
        s, e, q = periodic.runs_of(np.unique(flat, return_inverse=True)[1], first, 12)
        want = [(int(first[k]) + a, n, p) for k, d in enumerate(texts) for a, n, p in all_runs(d)]
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == sorted(want, key=lambda x: (x[0], x[2]))


def test_runs_of_regular_sequences():
    for w in (thue_morse(2048), [bin(i & -i).count("0") for i in range(1, 700)], [0] * 500, [i % 7 for i in range(1000)]):
        s, e, q = periodic.runs_of(np.unique(np.array(w), return_inverse=True)[1], np.array([0, len(w)]), 12)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == sorted(all_runs(w), key=lambda x: (x[0], x[2]))


def test_grammar_spells_the_words():
    r = random.Random(4)
    ids = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(3000)])
    g = periodic.Grammar(np.unique(ids, return_inverse=True)[1], np.array([0, 3000]))

    def spell(x):
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < g.terminals:
                out.append(y)
            else:
                todo += [int(g.right[y]), int(g.left[y])]
        return out

    assert spell(int(g.roots[0])) == ids.tolist() and len(g.size) < 2500
    for x in range(g.terminals, len(g.size), 37):
        assert spell(x) == ids[g.place[x] : g.place[x] + g.size[x]].tolist()


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op11(spark, docs):
    want = []
    for d, t in docs:
        w = planted(d, WORD.findall(t or ""))
        runs = all_runs(w) if len(w) < 3000 else None
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        if runs is not None:
            lines = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
            want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(w, runs))))
    rows = registry.op11_periodic_runs(spark, SF)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    asked = {x[0] for x in want}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(docs) and sorted(r for r in got if r[0] in asked) == sorted(want) and len(want) > 0.9 * len(docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_edge_rows(spark):
    long = " ".join(["tick", "tock", "tack"] * 40_000)
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t", 7), (None, "a b " * 6, 7), (5, "a b " * 6, 7), (5, "a b " * 6, 7), (6, long, 7), (7, "A a " * 6 + "x" * 50_000, 7), (8, "one\ntwo\x0bthree", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in periodic.find_runs(df).collect())
    ab = (12, [(0, 12, 2)], "a b")
    x = "x" * 50_000
    assert got == [(0, *ab), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (5, *ab), (5, *ab), (6, 120_000, [(0, 120_000, 3)], "tick tock tack"), (7, 13, [(0, 12, 2)], f"A a {x}"), (8, 3, [], "one two three")]
    assert periodic.find_runs(df.limit(0)).collect() == []


def ranking(docs, items, k=10):
    terms = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for d, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_op12(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = registry.op12_lexical_search(spark, SF)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and dict(rows.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in rows.collect()), key=str) == ranking(docs, items)


@pytest.mark.parametrize(("tree", "seed", "block"), [(16_384, 4096, 4_000_000), (40, 3, 60)])
def test_search_of_random_terms(spark, monkeypatch, tree, seed, block):
    """Small trees, few first documents and many blocks give the same ranks; hundreds of copies tie."""
    monkeypatch.setattr(dualtree, "TREE_DOCS", tree)
    monkeypatch.setattr(dualtree, "SEED_DOCS", seed)
    r = random.Random(tree)
    vocabulary = [f"t{k}" for k in range(60)] + ["É", "été", "中文", "ABC", "abc"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice([" ", ".", "_", "\x00", "-"]) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 5, 30]))) for k in range(500)]
    copy = text(20)
    docs += [(r.randrange(1000, 2000), copy) for _ in range(300)] + [(None, copy), (None, copy), (5000, None), (5001, ""), (5002, "!?"), (5003, "t1 " * 5000), (7, docs[7][1])]
    items = [(k, text(r.choice([1, 4, 12]))) for k in range(25)] + [(90, copy), (91, None), (92, ""), (93, "unknown words only"), (3, "t1 t1 t1 t2")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, n int, terms int").repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int").repartition(2)
    got = sorted((tuple(x) for x in dualtree.search(df, asked, block_chars=block).collect()), key=str)
    assert got == ranking(docs, items)
    for a, b in ((df.limit(0), asked), (df, asked.limit(0))):
        assert dualtree.search(a, b).collect() == []


def test_trees_prune(monkeypatch):
    """Most pairs of documents and items are left at inner nodes."""
    r = np.random.default_rng(2)
    rows, terms = 4000, 500
    row = np.repeat(np.arange(rows), 6)
    topic = r.integers(0, 50, rows)
    pair = np.unique((row << 32) | (topic[row] * 10 + r.integers(0, 10, len(row))))
    row, term = pair >> 32, pair & 0xFFFFFFFF
    docs = dualtree.Tree(row, term, r.integers(1, 1000, len(row)), rows, r.integers(1, 1000, len(row)))
    items = dualtree.Tree(np.repeat(np.arange(50), 4), np.sort(r.permuted(np.tile(np.arange(10), (50, 1)), axis=1)[:, :4] + 10 * np.arange(50)[:, None]).ravel(), np.full(200, 5), 50, np.full(200, 5))
    seen = []
    plain = dualtree.Tree.products
    monkeypatch.setattr(dualtree.Tree, "products", lambda self, level, nodes, dense: (seen.append(len(nodes)), plain(self, level, nodes, dense))[1])
    dualtree.walk(items, docs, np.arange(rows), terms, dualtree.Best(50, 10, np.zeros(50, np.int64), np.full(50, dualtree.NO_ID)))
    assert sum(seen) < 0.2 * rows * 50


def lines_kept(rows):
    keys = [[re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(UPPER) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for (d, _), ks in zip(rows, keys):
        for x in set(ks):
            if len(x) >= 20:
                holders[x].append(d)
    out = []
    for (d, t), ks in zip(rows, keys):
        gone = [len(h := holders.get(x, [])) >= 3 and d != max((y for y in h if y is not None), default=None) for x in ks]
        out.append((d, len(ks), sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)))
    return sorted(out, key=str)


def test_op13(spark, docs):
    rows = registry.op13_line_dedup(spark, SF)
    assert rows.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = [(d, n, m, sha(t)) for d, n, m, t in lines_kept(docs)]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 0


@pytest.mark.parametrize("hot", [1000, 5])
def test_line_dedup_of_edge_rows(spark, monkeypatch, hot):
    from quarry.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    a, b, c = "a line that many documents hold", "\t Another LINE of Some Length\x0b\r", "été: une ligne que trois ont"
    rows = [(k, f"{a}\nown {k}\n{b}\n{a} ") for k in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, a.upper()), (53, f" {a}\n"), (None, f"{a}\n{c}"), (None, f"{a}\n{c}"), (None, f"{a}\n{c}"), (60, c), (61, "É" + c[1:]), (62, "short\nshort\nshort")]
    rows += [(70, "\n".join(f"line {k} of a very long document" for k in range(30_000))), (71, "\n".join(f"line {k} of a very long document" for k in range(1, 30_000))), (69, "LINE 29999 of a very long document")]
    rows += [(None, x) for x in ["without any id, three times over"] * 30]
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "doc_id long, text string, lines int, copies int, pos int").repartition(5)
    got = sorted((tuple(r) for r in linededup.drop_repeated_lines(df).collect()), key=str)
    assert got == lines_kept(rows)
    assert linededup.drop_repeated_lines(df.limit(0)).collect() == []


def test_line_dedup_is_native(spark):
    plan = registry.op13_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert Tables(spark)  # its steps are tables of the shared folder
