"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with white space collapsed. A test item of ``n`` characters may
differ from a passage by ``k = n // 14`` edits. Cut into ``k + 1`` pieces, at least one piece of a
passage within the budget is untouched, so an Aho-Corasick automaton over the pieces finds every
candidate; Myers' bit-parallel recurrence, on integers of ``n`` bits, then gives the least edit
distance of the item to any substring of the window around the hits.

The items are the stated query set: they are read in blocks of at most ``BLOCK_CHARS`` characters
and each block is matched against all documents in one pass without a shuffle, so what travels to
the tasks is bounded whatever the size of the benchmark. Pieces that hit near the same diagonal share one
window; hits that lie close together merge into one longer window, so a text full of hits costs
its length once.

Null or empty documents and items match nothing; an item of fewer than 14 characters has no edits to spend and is found where it stands
inside a text as it is, whatever stands around it.
Repeated items give a row each by item_id; rows of the same doc_id, and places of an item in a document that tie, give a row for
the least distance. Very long texts are read whole. Without documents or items the result is empty. Extra columns are
ignored, or stay where documents are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an item for each edit that a passage may have.
CHARS_PER_EDIT = 14
#: Characters of benchmark text that one pass over the documents carries.
BLOCK_CHARS = 4_000_000


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item: str, text: str, budget: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text`` and where that substring ends;
    ``(budget + 1, -1)`` if it is over the budget."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, n
    best, end = budget + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
            if not best:
                break
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        self.pieces = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            parts = len(t) // CHARS_PER_EDIT + 1
            cuts = [len(t) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                held.setdefault(t[a:b], []).append((k, a))
        for piece, owners in held.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if held:
            self.pieces.make_automaton()

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of the items that the normalized text has within their budget."""
        starts: dict[int, list[int]] = {}
        out: list[tuple[int, int]] = []
        if not self.items or not text:
            return out
        for last, (size, owners) in self.pieces.iter(text):
            for k, a in owners:
                at = starts.setdefault(k, [])
                if not at or size < len(self.items[k][1]):  # of an item that is its only piece one hit is enough
                    at.append(last - size + 1 - a)
        for k, at in starts.items():
            item_id, item = self.items[k]
            budget = len(item) // CHARS_PER_EDIT
            best = 0 if item in text else budget + 1
            if best and budget:
                at.sort()
                low = high = at[0]
                for s in [*at[1:], None]:
                    if s is not None and s - high <= 2 * budget + len(item):
                        high = s
                        continue
                    window = text[max(0, low - budget) : high + len(item) + budget]
                    best = min(best, myers(item, window, budget)[0])
                    if s is not None:
                        low = high = s
            if best <= budget:
                out.append((item_id, best))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one Spark partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(item_id, text).toLocalIterator():
        t = normalize(row[1])
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((row[0], t))
        size += len(t)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): the items that a document holds within their error budget."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                rows = [(d, i, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, n in matcher.match(normalize(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "distance"])

        part = source.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; null texts stay. The rows are filtered
    where they are read, so documents are not shuffled."""
    spark, names = docs.sparkSession, docs.columns
    at = names.index(text)
    for block in item_blocks(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                clean = [not matcher.match(normalize(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
