"""Hand-made rows for thresholds, traps, payloads, pages and stateful jobs."""

import random
from datetime import datetime
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import fixed, scores
from quarry.operators import filters, joins, pages, similarity, writes
from quarry.sources import payloads
from quarry.streaming import limits


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_score_edges(spark):
    texts = [("good day to you",), ("short",), ("x" * 50,), ("x" * 51,), ("x" * 149,), ("x" * 150,), ("x" * 151,), ("learn " + "x" * 494,)]
    assert values(spark, texts, "t string", scores.structure_score(F.col("t"))) == [0.5, 0.5, 0.5, 0.7, 0.7, 0.7, 0.7, 0.7]
    assert values(spark, texts, "t string", F.round(scores.content_depth_score(F.col("t")), 4)) == [0.03, 0.01, 0.1, 0.102, 0.298, 0.3, 0.3, 0.4]
    assert values(spark, [("good", "", "x.com"), ("", "", "github.com"), ("go", "", "dev.to")], "a string, b string, d string", scores.tech_relevance(F.col("a"), F.col("b"), F.col("d"))) == [1.0, 0.3, 1.0]
    assert values(spark, [("         ",), ("python api",), ("java",)], "t string", F.round(scores.relevance_score(F.col("t")), 3)) == [0.0, 0.318, 0.0]


def test_domains(spark):
    rows = [("github.com",), ("blog.site.edu",), ("a.b.c",), ("x12345.tk",), ("bad_name.com",)]
    assert values(spark, rows, "d string", scores.domain_reputation(F.col("d"))) == [0.9, 0.8, 0.5, 0.4, 0.5]


def test_health_status_uses_the_score_before_the_cut(spark):
    rows = [(95.0, 95.0, 95.0, 3), (0.0, 0.0, 0.0, 0), (61.0, 71.0, 81.0, 1)]
    score = scores.health_score(F.col("c"), F.col("m"), F.col("d"), F.col("n"))
    assert values(spark, rows, "c double, m double, d double, n int", score) == [30, 90, 65]
    assert values(spark, rows, "c double, m double, d double, n int", scores.health_status(score)) == ["critical", "excellent", "warning"]


def test_dates(spark):
    rows = [("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("3/4/2024",), ("1/25/2024",), ("soon",), ("",)]
    got = values(spark, rows, "t string", scores.parse_date(F.col("t")))
    assert got == [datetime(2024, 1, 2, 1, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), datetime(2024, 4, 3), datetime(2024, 1, 25), None, None]


def test_normalizer_modes(spark):
    assert values(spark, [("  A,  b\n\\s ",)], "t string", scores.normalize(F.col("t"))) == ["a,  b\n\\s"]
    assert values(spark, [("  A,  b\n! ",)], "t string", scores.normalize(F.col("t"), "intended")) == ["a b"]


def test_payloads(spark):
    rows = [("duckduckgo", "q", '{"Abstract":"a","AbstractURL":"","RelatedTopics":[{"FirstURL":"u","Text":"T - d"},{"Text":"no url"}]}'), ("duckduckgo", "r", "{}"), ("google", "q", "{}"), ("bing", "q", "not json")]
    p = spark.createDataFrame(rows, "engine string, query string, payload string")
    assert [tuple(r) for r in payloads.parse_search(p, "duckduckgo").select("query", "url", "title", "description").collect()] == [("q", "u", "T", "T - d")]
    assert payloads.parse_search(p, "google").count() == payloads.parse_search(p, "bing").count() == 0
    with pytest.raises(ValueError):
        payloads.parse_search(p, "other")


def test_xml(spark):
    rows = [("a", '<urlset xmlns="x"><url><loc> u1 </loc></url></urlset>'), ("b", "<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("c", "<urlset><url>"), ("d", None), ("e", '<feed><entry><link href="f"/></entry></feed>'), ("g", "<rss><item><link>h</link></item></rss>")]
    x = spark.createDataFrame(rows, "source_id string, xml string")
    assert [(r.source_id, r.url) for r in payloads.parse_sitemaps(x).collect()] == [("a", "u1")]
    assert [(r.source_id, r.url) for r in payloads.parse_feeds(x).orderBy("source_id").collect()] == [("e", "f"), ("g", "h")]


def test_page_types_and_traps(spark):
    long = "word " * 60
    rows = [
        (1, "http://h/x", f'<article class="y"><nav>menu</nav><div class="ad">ad stays</div><p>{long}<span class="author">Ann</span></p></article><span class="author">Bob</span>'),
        (2, "http://h/docs/x", "<h1>T</h1><main>text</main><pre>0123456789abc</pre><code>short</code>"),
        (3, "http://h/tutorial", "<h1>T</h1><article>go<h2>Step one</h2><h2>End</h2></article>"),
        (4, "http://h/thread/1", '<div class="post-content">hi</div><i class="username">u</i>'),
        (5, "http://h/", "<title>t</title><body>all <b>of</b> it<script>no</script></body>"),
        (6, "http://h/", '<script type="application/ld+json">{"@type":"TechArticle"}</script><h1>x</h1>'),
        (7, "http://h/", None),
    ]
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].content_type for k in range(1, 8)] == ["article", "documentation", "tutorial", "forum", "general", "article", "general"]
    assert "ad stays" in got[1].content and "menu" not in got[1].content
    assert got[1].author == "Bob"  # attributes inside the content are gone when the author is looked for
    assert got[2].content == "text\\n\\nCode Examples:\\n0123456789abc"
    assert got[3].content.endswith("\\n\\nTutorial Steps:\\nStep one")
    assert (got[4].content, got[4].author) == ("hi", "u")
    assert (got[5].title, got[5].content, got[7].content) == ("t", "all of it", "")


def test_a_page_is_walked_once_until_it_changes():
    root = pages.parse("<body><h1>t</h1><main><p class='a b'>x</p><nav><p>y</p></nav><br/>z</main></body>")
    order = list(root.walk())
    assert [n.tag for n in order] == ["body", "h1", "main", "p", "nav", "p", "br"]
    assert root.known[1] == order and list(root.walk()) == order and root.known[1] is not order
    held = root.known[1]
    assert root.find_all("p") == [order[3], order[5]] and root.first("br") is order[6] and root.known[1] is held
    main = root.first("main")
    main.clean()
    assert [n.tag for n in root.walk()] == ["body", "h1", "main", "p", "br"] and [n.tag for n in main.walk()] == ["p", "br"]
    assert pages._find(root, ".a") is None and main.text(" ") == "x z"
    main.children.clear()
    main.changed()
    assert [n.tag for n in root.walk()] == ["body", "h1", "main"]


def test_pages_go_out_piece_by_piece():
    """What is made of a large batch leaves the worker in pieces, before all of it is read."""
    batch = pa.RecordBatch.from_pylist([{"page_id": k, "html": None if k == 5 else "<p>x"} for k in range(950)])
    seen = []

    def read(page_id, html):
        seen.append(page_id)
        return [(page_id, html)] * (page_id % 3)

    out = pages.by_page(read, "page_id long, html string")(iter([batch]))
    assert next(out).num_rows == sum(k % 3 for k in range(200)) and len(seen) == 200
    assert 199 + sum(x.num_rows for x in out) == sum(k % 3 for k in range(950)) and seen == list(range(950))
    long = pa.RecordBatch.from_pylist([{"page_id": 1, "html": "x" * (1 << 20)}] * 5)
    assert [x.num_rows for x in pages.by_page(read, "page_id long, html string")(iter([long]))] == [2, 2, 1]


def test_upsert_twice_is_once(spark):
    schema = "url string, title string, content string, content_hash string, author string, published_at timestamp, crawled_at timestamp"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "A", "x", "1", None, None, t), ("b", "B", "y", "2", None, None, t)], schema)
    new = spark.createDataFrame([("b", "B2", "z", "3", None, None, t), ("b", "B1", "w", "9", None, None, datetime(2023, 1, 1)), ("c", "C", "v", "4", None, None, t)], schema)
    now = F.lit("2024-02-01").cast("timestamp")
    once = writes.upsert_articles(old, new, now)
    assert {r.url: (r.title, r.outcome) for r in once.collect()} == {"a": ("A", "kept"), "b": ("B2", "updated"), "c": ("C", "new")}
    twice = writes.upsert_articles(once, new, now)
    assert {(r.url, r.content_hash) for r in twice.collect()} == {(r.url, r.content_hash) for r in once.collect()}
    assert {r.outcome for r in twice.collect()} == {"kept", "unchanged"}


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(120))
    rows = [(1, base), (2, base.replace("w60", "zz")), (3, " ".join(f"q{k}" for k in range(120))), (4, base.upper() + " "), (5, "short")]
    a = spark.createDataFrame(rows, "id long, content string").withColumn("content_hash", scores.content_hash(F.col("content")))
    assert [(r.a, r.b) for r in similarity.near_dup_pairs(a).collect()] == [(1, 2)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    """Clusters with one structure hash and ids over 200 apart, in buckets that are split into blocks."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 3)
    r = random.Random(5)
    shared = [f"common{k}" for k in range(20)]
    rows = []
    for cluster in range(6):
        own = [f"c{cluster}x{k}" for k in range(60)]
        for k in range(8):
            w = shared + own + shared + ["end"] * 9
            for _ in range(r.randrange(9)):
                w[20 + r.randrange(60)] = f"z{r.randrange(10**6)}"
            rows.append((1000 * k + 331 * cluster, " ".join(w)))
    rows += [(50000 + k, " ".join(r.choice(shared) for _ in range(60))) for k in range(6)]
    a = spark.createDataFrame(rows, "id long, content string").withColumn("content_hash", scores.content_hash(F.col("content")))
    for t in (0.85, 0.5):
        sets = {k: set(x.split()) for x, k in {x: k for k, x in sorted(rows, reverse=True)}.items()}
        want = {(x, y): round(len(sets[x] & sets[y]) / len(sets[x] | sets[y]), 6) for x in sets for y in sets if x < y}
        want = {k: v for k, v in want.items() if v >= t}
        got = {(x.a, x.b): x.similarity for x in similarity.near_dup_pairs(a, t).collect()}
        assert len(want) > 40 and got == want


def test_similar_per_article_over_blocks(spark, monkeypatch):
    """Every article against all of its category, in blocks, ties by id; a zero vector comes last."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    r = random.Random(8)
    rows = [(k, "ab"[k % 2], [float(r.randrange(-3, 4)) for _ in range(3)]) for k in range(0, 900, 15)] + [(1, "a", [0.0] * 3), (3, None, [1.0] * 3)]
    a = spark.createDataFrame(rows, "id long, category string, content_embedding array<float>")

    def cosine(x, y):
        n = (sum(i * i for i in x) * sum(i * i for i in y)) ** 0.5
        return round(sum(i * j for i, j in zip(x, y)) / n, 6) if n else None

    want = set()
    for k, c, e in rows:
        near = [(o, cosine(e, f)) for o, d, f in rows if c is not None and d == c and o != k]
        want |= {(k, o, s) for o, s in sorted(near, key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:5]}
    assert {(x.id, x.other_id, x.similarity) for x in similarity.similar_per_article(a).collect()} == want


def test_length_bands_of_any_length(spark):
    """Bands by stretches of lengths equal all pairs: empty and missing texts, many of one length, ties; no article meets a probe before only the best are left."""
    r = random.Random(12)
    sizes = [None, 0, 0, 1, 1, 2, 3, 4, 10, 13, 40_000, 51_999] + [100] * 40 + [r.randrange(300) for _ in range(150)]
    rows = [(k, None if n is None else "x" * n, float(r.randrange(3)), datetime(2024, 1, 20 if k % 9 else 1)) for k, n in enumerate(sizes)]
    a = spark.createDataFrame(rows, "id long, content string, quality_score double, crawled_at timestamp_ntz").repartition(3)
    found = joins.length_band_pairs(a.where("id % 3 = 0 or id < 12"), a, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 4)
    recent = [x for x in rows if x[1] is not None and x[3].day > 1]
    want = set()
    for i, p, _, _ in rows:
        if p is not None and (i % 3 == 0 or i < 12):
            near = [x for x in recent if x[0] != i and len(p) * 0.7 <= len(x[1]) <= len(p) * 1.3]
            want |= {(i, x[0], x[2]) for x in sorted(near, key=lambda x: (-x[2], x[0]))[:4]}
    assert {tuple(x) for x in found.collect()} == want and len(want) > 100
    assert "stretch" in found._jdf.queryExecution().optimizedPlan().toString()


def test_similar_query_crosses_labels(spark):
    """The whole-category query also finds neighbours with another embedding label."""
    label = {x.vec_id: x.label for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert any(label[x.id] != label[x.other_id] for x in catalog.QUERIES["similar_articles_per_article"](spark, "/root/testdata/sf0.001").collect())


def test_detect_content_update_scores_long_versions(spark, tmp_path):
    """The registered query against brute force, with texts on both sides of 3,000 characters."""
    r = random.Random(3)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma", f"w{k}"]) for _ in range(60 if k % 3 else 900)), "en", "src0", 0) for k in range(24)]
    docs += [(30, None, "en", "src0", 0), (32, docs[0][1], "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    urls = {}
    for a in catalog._versions(spark, str(tmp_path)).select("id", "url", "crawled_at", "content").collect():
        urls.setdefault(a.url, []).append((a.crawled_at, a.id, a.content))
    want = {}
    for versions in urls.values():
        versions.sort(key=lambda v: v[:2])
        for (_, _, a), (_, k, b) in zip(versions, versions[1:]):
            if a is not None:
                want[k] = (round(SequenceMatcher(None, a, b).ratio(), 6) if a and b else 0.0, len(b) - len(a) if b is not None else None)
    got = {x.id: (x.similarity, x.length_change) for x in catalog.QUERIES["detect_content_update"](spark, str(tmp_path)).collect()}
    assert len(got) > 20 and got == want


def test_language(spark):
    rows = [("the cat is on the mat and it is not for you",), ("le chat est sur la table et il ne dort pas",), ("der Hund und die Katze sind nicht im Haus",), ("",)]
    assert values(spark, rows, "t string", scores.detect_language(F.col("t"))) == ["en", "fr", "de", "en"]


def test_adaptive_limits():
    now = (*fixed.DEFAULT_LIMIT, 0)
    assert limits.step_limit(*now, 429, 0.1) == (0.5, 2, 2.0, 1)
    for _ in range(6):
        now = limits.step_limit(*now, 500, 0.1)
    assert now == (0.8, 3, 1.5, 6)
    for _ in range(40):
        now = limits.step_limit(*now, 200, 0.1)
    assert now == (2.0, now[1], now[2], 0) and now[1] == 10 and now[2] < 1.5


def test_empty_tables(spark):
    a = spark.createDataFrame([], "id long, url string, content string, content_hash string, crawled_at timestamp, source_id string, quality_score double, title string, tags array<string>")
    assert similarity.exact_dedup(a).count() == 0
    assert joins.latest_per_url(a).count() == 0
    assert filters.text_search(a, "x").count() == 0


def test_argument_checks():
    with pytest.raises(ValueError):
        filters.check_paging(0, 10)
    with pytest.raises(ValueError):
        filters.check_search("a", 0.5)
    assert filters.check_search(" ab ", 0.5) == "ab"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "id long, tags array<string>")
    payloads.export_table(df, str(tmp_path / "c"), "csv")
    payloads.export_table(df, str(tmp_path / "j"), "json")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().tags == '["a"]'
    assert spark.read.json(str(tmp_path / "j")).first().tags == ["a"]


def test_sequence_bounds_lose_nothing(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcd ") for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(200):
        t = list(r.choice(texts))
        for _ in range(r.randrange(0, 14)):
            t[r.randrange(len(t))] = r.choice("abcdx")
        rows.append((k, r.choice(texts), "".join(t)))
    df = spark.createDataFrame(rows + [(900, "", "a"), (901, None, "b")], "id int, a string, b string")
    both = df.select("id", F.round(similarity.sequence_ratio("a", "b"), 6).alias("x"), F.round(similarity.sequence_at_least(0.85)("a", "b"), 6).alias("y")).collect()
    assert {r.id: r.x for r in both if r.x >= 0.85} == {r.id: r.y for r in both if r.y is not None and r.y >= 0.85}


def test_declared_tables(spark, tmp_path):
    from quarry.sources import tables

    out = catalog.S.crawl_jobs(spark, "/root/testdata/sf0.001")
    out.drop("status").write.parquet(str(tmp_path / "jobs"))
    got = tables.read_files(spark, "crawl_jobs", str(tmp_path / "jobs"))
    assert got.columns == ["id", "source_id", "status", "started_at"] and got.where("status is not null").count() == 0 and got.count() == out.count()
    options = tables.jdbc_options("articles", "jdbc:postgresql://db/content", "0", "1000000", 32, user="reader")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "32" and options["user"] == "reader"
    with pytest.raises(ValueError):
        tables.jdbc_options("articles", "jdbc:x", "0", "1", 0)
    for name in tables.SCHEMAS:  # the derived tables have the declared columns and types
        have = {f.name: f.dataType.simpleString() for f in getattr(catalog.S, name)(spark, "/root/testdata/sf0.001").schema}
        for f in tables.schema(name):
            assert have[f.name] == f.dataType.simpleString(), (name, f.name)


def test_parities_of_more_classes_rule_out_long_sets(spark):
    """Two sets of 2,000 hashes with a Jaccard of 0.6: parities of 256 classes pass them at 0.85, those of 4,096 do not; neither exceeds the words that differ."""
    r = random.Random(3)
    h = [r.getrandbits(63) for _ in range(2500)]
    sets = spark.createDataFrame([(1, h[:2000]), (2, h[500:])], "id long, words array<long>")
    differ = {}
    for longs in (4, 64):
        (_, n, x), (_, m, y) = sorted(similarity.set_signatures(sets, longs).collect())
        assert n == m == 2000 and len(x) == len(y) == longs
        differ[longs] = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y))
    most = 0.15 / 1.85 * 4000
    assert differ[4] <= most < differ[64] <= 1000


def test_rates_are_running_sums(spark):
    """Frames that slide are counted anew for each request, which grows with the square of a busy minute."""
    log = spark.range(3000).select(F.col("id").alias("event_id"), F.lit("d").alias("domain"), F.timestamp_micros(F.col("id") * 40_000).alias("ts"))
    found = joins.rate_violations(log)
    assert "RangeFrame, -" not in found._jdf.queryExecution().analyzed().toString()
    last = found.where("event_id = 2999").first()
    assert (found.count(), last.in_1s, last.in_10s, last.in_60s, last.gap_us) == (2999, 26, 251, 1501, 40_000)
