"""The sequence ratio against difflib, and the search by it against all pairs."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest

from quarry import catalog
from quarry.functions import sequence
from quarry.operators import similarity

SF = "/root/testdata/sf0.001"
ALPHABETS = ["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz ", "aaaaaaaab" + "".join(map(chr, range(200, 300))), "é中🙂a b"]


def edited(r, text, most):
    out = list(text)
    for _ in range(r.randrange(most)):
        k = r.randrange(len(out) + 1)
        out[k : k + r.randrange(3)] = r.choice(["", "x", "qq"])
    return "".join(out)


def test_ratio_equals_difflib():
    r = random.Random(8)
    for _ in range(800):
        letters = r.choice(ALPHABETS)
        a = "".join(r.choice(letters) for _ in range(r.choice([1, 5, 30, 199, 200, 260, 700])))
        b = edited(r, a, 8) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.choice([1, 30, 200, 500])))
        if not b:
            continue
        want = SequenceMatcher(None, a, b)
        assert sequence.ratio(a, b) == want.ratio()
        matched = sum(m.size for m in want.get_matching_blocks())
        assert sequence.common_at_least(a, b, matched) and not sequence.common_at_least(a, b, min(len(a), len(b)) + 1)
    assert sequence.ratio("", "a") == sequence.ratio(None, "a") == 0.0


def test_longest_part_of_a_range_is_found_among_the_first():
    """Equal to a look at all stretches, of which a whole one ends the search."""
    r = random.Random(11)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(1, 60))) for _ in range(2))
        found = sequence._stretches(a, b)
        held = list(zip(*(x.tolist() for x in found)))
        assert held == sorted(held, key=lambda s: (-s[2], s[0], s[1]))
        assert all(a[i : i + n] == b[j : j + n] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]) and a[i + n : i + n + 1] != (b[j + n : j + n + 1] or "-") for i, j, n in held)
        alo, blo = r.randrange(len(a)), r.randrange(len(b))
        ahi, bhi = r.randrange(alo, len(a)) + 1, r.randrange(blo, len(b)) + 1
        cut = [(min(ahi - i, bhi - j, n) - k, i + k, j + k) for i, j, n in held for k in [max(alo - i, blo - j, 0)]]
        n, i, j = min(((-n, i, j) for n, i, j in cut if n > 0), default=(0, alo, blo))
        assert sequence._longest(held, alo, ahi, blo, bhi) == sequence._longest(found, alo, ahi, blo, bhi) == (i, j, -n)
        looked = []
        sequence._longest((looked.append(s) or s for s in held), 0, len(a), 0, len(b))
        assert len(looked) <= 1


def test_ratio_of_real_texts():
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) between 10 and 6000 order by doc_id limit 60").fetchall()]
    for a, b in zip(texts, texts[7:]):
        assert sequence.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_many_equal_characters_go_to_difflib(monkeypatch):
    monkeypatch.setattr(sequence, "MOST_PAIRS", 10)
    assert sequence.ratio("abc" * 20, "abd" * 20) == SequenceMatcher(None, "abc" * 20, "abd" * 20).ratio()


def test_common_subsequence_against_a_table():
    r = random.Random(9)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(1, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        assert sequence.common_at_least(a, b, row[-1]) and not sequence.common_at_least(a, b, row[-1] + 1)


def test_shared_grams_bound_the_matching_characters():
    r = random.Random(10)
    for _ in range(300):
        letters = r.choice(ALPHABETS)
        a = "".join(r.choice(letters) for _ in range(r.choice([3, 30, 199, 200, 260, 700])))
        b = edited(r, a, 40) or "x"
        assert sequence.ratio(a, a) == SequenceMatcher(None, a, a).ratio()
        shared = similarity.Probes([(1, a), (2, "zz" + a)]).shared(b)
        matched = [sequence.matching(p, b) for p in (a, "zz" + a)]
        assert all(s >= m - sequence.gram_slack(b) for s, m in zip(shared, matched))


def test_candidates_are_about_the_matches():
    """Texts of one language do not all go to the slow bounds: shared grams rule them out for all probes at once."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where length(text) >= 200 order by doc_id").fetchall()
    probes = similarity.Probes(rows[::10])
    found = sum(len(probes.near(t, 0.85)) for _, t in rows)
    assert found <= 1.2 * sum(similarity._ratio_over(probes.rows[k][1], t, 0.85) is not None for _, t in rows for k in probes.near(t, 0.85))


def all_pairs(probes, rows, threshold):
    out = {}
    for p, x in probes:
        for i, y in rows:
            if p != i and x and y and 2 * min(len(x), len(y)) >= (threshold - 1e-6) * (len(x) + len(y)):
                m = SequenceMatcher(None, x, y)
                if m.quick_ratio() >= threshold - 1e-6 and round(m.ratio(), 6) >= threshold:
                    out[p, i] = round(m.ratio(), 6)
    return out


def test_registered_search(spark):
    rows = [tuple(r) for r in catalog.S.articles(spark, SF).select("id", "content").collect()]
    got = {(r.probe_id, r.id): r.similarity for r in catalog.QUERIES["near_dup_sequence"](spark, SF).collect()}
    assert got == all_pairs([x for x in rows if x[0] % 50 == 0], rows, 0.85)


@pytest.mark.parametrize(("threshold", "block"), [(0.85, 32 << 20), (0.6, 2000), (1.0, 32 << 20)])
def test_search_of_edited_texts(spark, monkeypatch, threshold, block):
    """All pairs at any threshold, in one block of probes or in many; copies in their hundreds."""
    monkeypatch.setattr(similarity, "QUERY_BYTES", block)
    r = random.Random(int(threshold * 100))
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([20, 90, 240]))) for _ in range(8)]
    rows = [(k, edited(r, r.choice(base), 12)) for k in range(120)] + [(200 + k, base[0]) for k in range(150)] + [(900, None), (901, ""), (902, "é"), (903, "é")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    got = [tuple(x) for x in similarity.sequence_matches(df.where("id % 5 = 0 or id > 900"), df, threshold).collect()]
    want = all_pairs([x for x in rows if x[0] % 5 == 0 or x[0] > 900], rows, threshold)
    assert len(got) == len(want) > 0 and {(p, i): s for p, i, s in got} == want
    assert similarity.sequence_matches(df.limit(0), df, threshold).collect() == similarity.sequence_matches(df, df.limit(0), threshold).collect() == []
    plan = similarity.sequence_matches(df, df, threshold)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_scores_are_computed_once(spark):
    """Neither the ratio nor a text's words stand above the filter or the join a second time."""
    plan = catalog.QUERIES["find_similar_sequence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1
    plan = catalog.QUERIES["length_band_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_candidates_by_grams_of_any_length_are_without_loss():
    """Each length of grams bounds the matching characters; every probe over the threshold is named, and the others end early."""
    r = random.Random(12)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 7))) + r.choice(["", "", "k", "v", "Q", "é"]) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([20, 60, 200, 400]))) for _ in range(6)]
    probes = similarity.Probes([(k, edited(r, r.choice(base), 60)) for k in range(60)] + [(100 + k, base[3]) for k in range(4)])
    used, found = set(), 0
    for _ in range(15):
        text = edited(r, r.choice(base), 60)
        want = [SequenceMatcher(None, t, text) for _, t in probes.rows]
        for size in similarity.GRAMS:
            got = [probes.shared(text, size, spare) for spare in (0, 7)]
            assert all(a >= sum(m.size for m in w.get_matching_blocks()) - sequence.gram_slack(text, size) and a - 7 <= b <= a for a, b, w in zip(*got, want))
            used |= {size} if 0.7 * len(text) > sequence.gram_slack(text, size) else set()
        for low in (0.6, 0.85, 1.0):
            over = [(p, w.ratio()) for (p, _), w in zip(probes.rows, want) if w.ratio() >= low]
            assert probes.reached(text, low) == over
            assert [sequence.ratio_at_least(t, text, low) for _, t in probes.rows] == [w.ratio() if w.ratio() >= low else None for w in want]
            found += len(over)
    assert len(used) > 1 and found >= 40


def test_a_pair_that_cannot_reach_the_threshold_ends_early(monkeypatch):
    r = random.Random(13)
    a, b = ("".join(chr(r.randrange(200, 500)) for _ in range(1500)) for _ in range(2))
    looked, real = [], sequence._longest
    monkeypatch.setattr(sequence, "_longest", lambda *x: looked.append(1) or real(*x))
    assert sequence.ratio(a, b) < 0.85
    whole = len(looked)
    assert sequence.ratio_at_least(a, b, 0.85) is None and 4 * (len(looked) - whole) < whole
    monkeypatch.setattr(sequence, "MOST_PAIRS", 10)
    monkeypatch.setattr(sequence, "SequenceMatcher", None)  # nor does it go to difflib, which is slow
    assert sequence.ratio_at_least(a, b, 0.85) is None


def test_equal_texts_are_compared_once(monkeypatch):
    r = random.Random(14)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150))
    probes = similarity.Probes([(k, base) for k in range(50)])
    compared, real = [], sequence.matching
    monkeypatch.setattr(sequence, "matching", lambda *x: compared.append(1) or real(*x))
    assert len(probes.reached(base[:70] + "-" + base[70:], 0.85)) == 50 and len(compared) == 1


def test_articles_meet_only_blocks_of_their_lengths(spark, monkeypatch):
    """Blocks of probes are by length, so an article does not pass through all of them."""
    monkeypatch.setattr(similarity, "QUERY_BYTES", 20_000)
    r = random.Random(15)
    df = spark.createDataFrame([(k, "".join(r.choice("abcdef ") for _ in range(10 * 2 ** (k % 8)))) for k in range(96)], "id long, content string")
    out = similarity.sequence_matches(df, df)
    assert out.count() == 0
    node, todo, met = None, [out._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        children = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName().startswith("MapInArrow"):
            met += [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, c).count() for c in children]
        else:
            todo += children
    assert len(met) >= 6 and sum(met) <= 3 * 96
