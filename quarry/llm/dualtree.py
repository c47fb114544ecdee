"""Ranked lexical search with two trees.

Terms are runs of letters, digits and characters beyond ASCII, A to Z in lower case. A document's score for an item sums
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the item's terms, repeats included (see ``search`` for w and m).

1. One pass over the texts keeps what the items' terms need: of each document its length and the counts of those terms.
   Spark sums documents, lengths and document frequencies from that table.
2. In each task the documents make a hierarchy: sorted by their strongest terms, eight nodes make one above them, and a node
   holds the coordinate maxima of what is below it. The items make one likewise.
3. Both are walked together. The product of an item node's and a document node's maxima bounds every score below the
   two; where it stays under the weakest kth score of the items below, the whole batch of pairs is left. At the leaves
   the bound is the score.
4. Each task returns at most k documents an item, and a window ranks them.

A first walk over at most ``SEED_DOCS`` documents gives each item a kth score to start from. It only saves time: any document's
score is a lower bound for the kth of all, and the walk proper covers every document.

Items are the stated query set. They pass through the driver in blocks of at most ``BLOCK_CHARS`` characters, which bounds what
is broadcast; each block costs a pass over the texts.

Null, empty and blank texts have no terms and are not counted; items without terms have no rows. Each row is a document or an
item: repeated rows are ranked each, and rows that share an item_id have ranks of their own. Equal scores go by ascending
doc_id; a document without doc_id counts and is ranked after all others of its score. Very long texts are read whole. Without
documents or items the result is empty. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables
from .words import LOWER, Words, hash_spans

#: Bytes that end a term: all of ASCII but letters and digits.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[k for k in range(128) if not chr(k).isalnum()]] = True
#: Characters of items that one pass carries, documents of the first walk, documents and entries of one tree, children of a node.
BLOCK_CHARS, SEED_DOCS, TREE_DOCS, TREE_ENTRIES, FAN = 4_000_000, 4096, 16_384, 4_000_000, 8
NO_ID = (1 << 63) - 1


def term_counts(texts: list[str | None]) -> list[Counter]:
    """Terms of each text with their counts."""
    array = pa.array(texts, pa.string())
    words = Words(array, lower=True, separator=SEPARATOR)
    data = LOWER[words.data].tobytes()
    spans = list(zip(words.start.tolist(), words.end.tolist()))
    return [Counter(data[a:b] for a, b in spans[words.of(k)]) for k in range(len(texts))]


class Vocabulary:
    """Terms of the items, found again in texts by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        stop = np.cumsum([0, *map(len, terms)])
        (h,) = hash_spans(data, stop[:-1], stop[1:], 1)
        order = np.argsort(h, kind="stable")
        self.data, self.hash, self.term, self.start, self.end = data, h[order], order, stop[:-1][order], stop[1:][order]
        self.alike = int(np.unique(h, return_counts=True)[1].max()) if len(h) else 0

    def find(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary, -1 for others."""
        out = np.full(len(words.hash), -1, dtype=np.int64)
        first = np.searchsorted(self.hash, words.hash, side="left")
        for step in range(self.alike):
            at = np.minimum(first + step, len(self.hash) - 1)
            some = np.flatnonzero(self.hash[at] == words.hash)
            size = words.end[some] - words.start[some]
            know = at[some]
            fits = size == self.end[know] - self.start[know]
            some, know, size = some[fits], know[fits], size[fits]
            for k in range(0, len(some), 1 << 16):
                s, v, z = some[k : k + (1 << 16)], know[k : k + (1 << 16)], size[k : k + (1 << 16)]
                stop = np.cumsum(z)
                inside = np.arange(stop[-1]) - np.repeat(stop - z, z)
                same = LOWER[words.data[np.repeat(words.start[s], z) + inside]] == self.data[np.repeat(self.start[v], z) + inside]
                good = np.logical_and.reduceat(same, stop - z)
                out[s[good]] = self.term[v[good]]
        return out


def count_terms(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and (row, term, count) of the known ones by row and term."""
    words = Words(texts, lower=True, separator=SEPARATOR)
    sizes = np.diff(words.first)
    found = vocabulary.find(words)
    known = np.flatnonzero(found >= 0)
    row = np.repeat(np.arange(len(sizes)), sizes)[known]
    pair, count = np.unique((row << 32) | found[known], return_counts=True)
    return sizes, pair >> 32, pair & 0xFFFFFFFF, count


class Tree:
    """Levels of nodes over rows of (row, term, value) entries, sorted by row; level 0 are the rows. Each level is
    (begin of each node's entries, terms, values); ``order`` are the rows as they lie on level 0."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, strength: np.ndarray, fan: int = FAN):
        # Rows by their strongest term, then by their second: what is alike gets together.
        by = np.lexsort((-strength, row))
        begin = np.searchsorted(row, np.arange(rows + 1))
        top = np.full((2, rows), -1, dtype=np.int64)
        for k in (0, 1):
            has = np.flatnonzero(begin[1:] - begin[:-1] > k)
            top[k, has] = term[by[begin[:-1][has] + k]]
        self.order = np.lexsort((top[1], top[0]))
        place = np.empty(rows, dtype=np.int64)
        place[self.order] = np.arange(rows)
        node, self.fan, self.levels = place[row], fan, []
        count = rows
        while True:
            key = (node << 32) | term
            at = np.argsort(key, kind="stable")
            key, value = key[at], value[at]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            value = np.maximum.reduceat(value, first) if len(first) else value
            node, term = key[first] >> 32, key[first] & 0xFFFFFFFF
            self.levels.append((np.searchsorted(node, np.arange(count + 1)), term, value))
            if count <= 1:
                break
            node, count = node // fan, -(-count // fan)

    def size(self, level: int) -> int:
        return len(self.levels[level][0]) - 1

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children, on the next level down, of nodes of a level."""
        kids = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        return kids[kids < self.size(level - 1)]

    def products(self, level: int, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner product of each node's maxima with a dense vector."""
        begin, term, value = self.levels[level]
        size = begin[nodes + 1] - begin[nodes]
        stop = np.cumsum(size)
        at = np.repeat(begin[nodes] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        total = np.concatenate([[0], np.cumsum(dense[term[at]] * value[at])])
        return total[stop] - total[stop - size]


class Best:
    """The k best (score, doc_id) of each item, and what a document must reach to matter."""

    def __init__(self, items: int, k: int, score: np.ndarray, doc: np.ndarray):
        self.k, self.score, self.doc = k, score.copy(), doc.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = np.concatenate([self.found[item][0], score]), np.concatenate([self.found[item][1], doc])
        top = np.lexsort((d, -s))[: self.k]
        self.found[item] = s, d = s[top], d[top]
        if len(s) == self.k and (s[-1], -d[-1]) > (self.score[item], -self.doc[item]):
            self.score[item], self.doc[item] = s[-1], d[-1]


def walk(items: Tree, docs: Tree, ids: np.ndarray, terms: int, best: Best) -> None:
    """Both trees together from their roots."""
    least = [None] * len(items.levels)
    least[0] = best.score[items.order]
    for level in range(1, len(items.levels)):
        least[level] = np.minimum.reduceat(least[level - 1], np.arange(0, len(least[level - 1]), items.fan))
    low = [ids[docs.order]]
    for level in range(1, len(docs.levels)):
        low.append(np.minimum.reduceat(low[-1], np.arange(0, len(low[-1]), docs.fan)))
    dense = np.zeros(terms, dtype=np.int64)
    todo = [(len(items.levels) - 1, 0, len(docs.levels) - 1, np.zeros(1, np.int64))]
    while todo:
        i_level, i, d_level, nodes = todo.pop()
        begin, term, value = items.levels[i_level]
        mine = slice(begin[i], begin[i + 1])
        dense[term[mine]] = value[mine]
        bound = docs.products(d_level, nodes, dense)
        dense[term[mine]] = 0
        if i_level:
            keep = (bound > 0) & (bound >= least[i_level][i])
        else:
            item = items.order[i]
            keep = (bound > 0) & ((bound > best.score[item]) | ((bound == best.score[item]) & (low[d_level][nodes] <= best.doc[item])))
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            continue
        if not i_level and not d_level:
            best.add(item, bound, low[0][nodes])
            continue
        if d_level:
            nodes = docs.below(d_level, nodes)
        below = items.below(i_level, np.array([i])).tolist() if i_level else [i]
        todo.extend((max(0, i_level - 1), j, max(0, d_level - 1), nodes) for j in below)


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one Spark partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("long"), text).toLocalIterator():
        t = row[1] or ""
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((row[0], t))
        size += len(t)
    if held:
        yield held


def _search_block(source: DataFrame, block: list[tuple[int, str]], k: int, tables: Tables) -> DataFrame | None:
    """(place, item_id, doc_id, score): for each task and item of the block at most k documents that may be among its best."""
    spark = source.sparkSession
    counts = term_counts([t for _, t in block])
    terms = sorted(set().union(*counts))
    if not terms:
        return None
    number = {t: n for n, t in enumerate(terms)}
    known = spark.sparkContext.broadcast(Vocabulary(terms))

    def count(batches):
        for batch in batches:
            n, row, term, tf = count_terms(batch.column(1), known.value)
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    vectors = tables.keep(source.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>"), "terms")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    n_docs, length = total["docs"], total["terms"]
    weight = np.zeros(len(terms), dtype=np.int64)
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    row = np.repeat(np.arange(len(block)), [len(c) for c in counts])
    term = np.array([number[t] for c in counts for t in c], dtype=np.int64)
    value = np.array([n for c in counts for n in c.values()], dtype=np.int64) * weight[term]
    tree = spark.sparkContext.broadcast((Tree(row, term, value, len(block), value), weight))

    def walker(start):
        def run(batches):
            items, weights = tree.value
            best = Best(len(block), k, *start.value)
            held, entries, size = [], 0, 0

            def search():
                t = pa.Table.from_batches(held)
                ids = t.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
                n = t.column("n").to_numpy()
                sizes = t.column("terms").combine_chunks().value_lengths().to_numpy()
                term, tf = (t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                if 75 * int(n.max()) * n_docs >= 1 << 63:
                    n = n.astype(object)
                m = (25 + 75 * n * n_docs // length).astype(np.int64)
                value = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
                row = np.repeat(np.arange(len(ids)), sizes)
                walk(items, Tree(row, term, value, len(ids), value * weights[term]), ids, len(weights), best)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
                    entries += len(batch.column("terms").flatten())
                if size >= TREE_DOCS or entries >= TREE_ENTRIES:
                    search()
                    held, entries, size = [], 0, 0
            if held:
                search()
            place = np.repeat(np.arange(len(block)), [len(s) for s, _ in best.found])
            score, doc = (np.concatenate(x) for x in zip(*best.found))
            doc = pa.array(doc, mask=doc == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([block_ids[p] for p in place], pa.int64()), doc, pa.array(score)], names=["place", "item_id", "doc_id", "score"])

        return run

    block_ids = [i for i, _ in block]
    schema = "place long, item_id long, doc_id long, score long"
    nothing = np.zeros(len(block), dtype=np.int64), np.full(len(block), NO_ID, dtype=np.int64)
    held = vectors.where(F.size("terms") > 0)
    first = Best(len(block), k, *nothing)
    for r in held.limit(SEED_DOCS).mapInArrow(walker(spark.sparkContext.broadcast(nothing)), schema).toLocalIterator():  # at most k rows an item
        first.add(r.place, np.array([r.score]), np.array([NO_ID if r.doc_id is None else r.doc_id]))
    return held.mapInArrow(walker(spark.sparkContext.broadcast((first.score, first.doc))), schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    N counts the documents with a term, L all their terms, n a document's terms, df the documents holding a term, tf its
    occurrences in a document; w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 25 + (75 * n * N) div L."""
    tables = Tables(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for b, block in enumerate(item_blocks(items, item_id, item_text, block_chars)):
        found = _search_block(source, block, k, tables)
        if found is not None:
            found = found.withColumn("block", F.lit(b))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
