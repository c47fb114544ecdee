"""Substring deduplication by recompression.

A text is a sequence of words, named by hashes of their bytes. In each round of recompression
neighbours merge into one symbol where they are equal (runs) or where the round gives the left one
the bit 0 and the right one the bit 1 (pairs). The name of a symbol is a hash of what it stands for,
so naming is global without a dictionary: equal substrings get the same symbols inside, wherever they
stand. How far a symbol depends on its surroundings is tracked exactly as its footprint.

1. Each window of ``window`` words picks one of the symbols whose footprint it holds (the least by
   name), so equal windows pick equal symbols. The picked ones are far fewer than the words. Spark counts
   them over all documents, keyed by the words of the footprint.
2. A window whose pick occurs once occurs once itself. All others are candidates; their word
   sequences are counted as hashes of 96 bits, which verifies the repeats.
3. Words under a window that occurs twice or more go.

Counts are aggregated before they are shuffled, and only what occurs once comes back (its place is
known from the aggregate itself), so no frequent symbol or window is ever gathered or joined. Documents
with the same words are counted as one text in step 2; all but the first skip it, and a digest with many
copies is dealt over many tasks.

Null, empty and blank texts keep the empty string. Texts shorter than a window are kept, words
joined by one blank; very long ones are read whole. Every row is a document, also a repeated one, whose windows
then occur twice, and one without doc_id; rows that share a doc_id are told apart by their texts. Windows that overlap
or tie are all judged on the input, so no order matters. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, join_few
from .words import Words, _powers, joined_words, mix

ROUNDS = 4
FAR = 1 << 40
STEP_NAME = np.uint64(0x8CB92BA72F3D8DD7)


class Symbols:
    """Symbols of the documents of a batch after some rounds: name, first and last word (exclusive)
    and footprint of each; ``doc`` tells documents apart."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        n = len(names)
        self.name, self.doc = names, doc
        self.low, self.high = np.arange(n), np.arange(1, n + 1)  # footprint

    def round(self, k: int) -> None:
        x, doc, n = self.name, self.doc, len(self.name)
        if not n:
            return
        bit = mix(x + np.uint64(0x9FB21C651E98DF25 * (k + 1) % (1 << 64))) >> np.uint64(63)
        begins = np.ones(n, dtype=bool)
        begins[1:] = (doc[1:] != doc[:-1]) | ~((x[1:] == x[:-1]) | ((bit[:-1] == 0) & (bit[1:] == 1)))
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1
        size = last - first + 1
        within = np.arange(n) - np.repeat(first, size)
        factor = np.full(int(size.max()), STEP_NAME, dtype=np.uint64)
        factor[0] = 1
        np.multiply.accumulate(factor, out=factor)
        name = mix(np.add.reduceat(mix(x + np.uint64(k)) * factor[within], first) + size.astype(np.uint64))
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        self.low = np.where((first > 0) & (doc[before] == doc[first]), self.low[before], -FAR)
        self.high = np.where((last < n - 1) & (doc[after] == doc[last]), self.high[after], FAR)
        self.name, self.doc = name, doc[first]


def _running(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sum of word hashes, and the inverse powers that shift a difference to 0."""
    up, down = _powers(k, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return total, down


def span_hashes(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def picks(words: Words, window: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the first window of each stretch of windows with the same pick, counted from
    the document's start, and the key of that pick; key 0 where a window holds no footprint."""
    first = words.first
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    symbols = Symbols(words.hash, doc)
    for k in range(rounds):
        symbols.round(k)
    n = len(words.hash)
    none = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(sizes)
    starts = np.flatnonzero(np.arange(n) + window <= first[1:][doc]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return none
    inside = np.flatnonzero((symbols.low >= 0) & (symbols.high <= n) & (symbols.high - symbols.low <= window))
    chosen = np.full(len(starts), -1, dtype=np.int64)
    if len(inside):
        low, high, name = symbols.low[inside], symbols.high[inside], symbols.name[inside]
        # Footprints move on with the symbols, so those in a window are neighbours in this list.
        a, b = np.searchsorted(low, starts, side="left"), np.searchsorted(high, starts + window, side="right")
        bits = np.uint64(max(1, int(len(inside)).bit_length()))
        table = [((mix(name) >> bits) << bits) | np.arange(len(inside), dtype=np.uint64)]
        width = b - a
        while 1 << len(table) <= max(1, int(width.max())):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]) if len(table[-1]) > half else table[-1])
        some = np.flatnonzero(width > 0)
        level = np.frexp(width[some].astype(np.float64))[1] - 1
        for k, least in enumerate(table):
            at = some[level == k]
            if len(at):
                best = np.minimum(least[a[at]], least[b[at] - (1 << k)])
                chosen[at] = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        total, down = _running(words.hash, 0)
        key = np.concatenate([span_hashes(total, down, low, high) | np.uint64(1), [np.uint64(0)]]).view(np.int64)
    else:
        key = np.zeros(1, np.int64)
    owner = doc[starts]
    change = np.ones(len(starts), dtype=bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(change)
    where = (starts[at] - first[:-1][owner[at]]).astype(np.int32)
    found = key[chosen[at]]
    cuts = np.searchsorted(owner[at], np.arange(len(sizes) + 1))
    return [(where[x:y], found[x:y]) for x, y in zip(cuts, cuts[1:])]


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's word sequence: sums of its words' hashes mixed with their places."""
    sizes = np.diff(words.first)
    place = mix((np.arange(len(words.hash)) - np.repeat(words.first[:-1], sizes) + 1).astype(np.uint64))
    out = []
    for h, seed in ((words.hash, STEP_NAME), (words.hash2, ~STEP_NAME)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place * seed), dtype=np.uint64)])
        out.append(mix(total[words.first[1:]] - total[words.first[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def window_names(words: np.ndarray, window: int, seed: np.uint64) -> np.ndarray:
    """A hash of the ``window`` words from each word on: names of 2, 4, 8, ... words, each mixed from two of half its length,
    and two of those, overlapping, for the window."""
    name, size = mix(words ^ seed), 1
    while 2 * size <= window:
        name = mix(name[: max(0, len(name) - size)] * STEP_NAME + (name[size:] ^ seed))
        size *= 2
    return mix(name[: max(0, len(words) - window + 1)] * STEP_NAME + mix(name[window - size :] ^ seed))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), type=kind))


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one blank."""
    counts = np.add.reduceat(np.append(keep.astype(np.int64), 0), np.minimum(words.first[:-1], len(keep))) * (np.diff(words.first) > 0)
    return joined_words(words.data, words.start[keep], words.end[keep], counts)


def repeated_substrings(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row: the text without the words of windows
    whose sequence also starts anywhere else."""
    tables = Tables(docs.sparkSession)
    # Rows are told apart by doc_id, or a hash of the text in its place, and another hash of the text.
    own = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), own.alias("k1"), F.hash(F.col(text)).alias("k2"))

    def pick(batches):
        for batch in batches:
            words = Words(batch.column(2), hashes=2)
            one, two = _digests(words)
            found = picks(words, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(one), pa.array(two), pa.array(np.diff(words.first)), _lists([w for w, _ in found], pa.int32()), _lists([k for _, k in found], pa.int64())], names=["k1", "k2", "d1", "d2", "n", "at", "keys"])

    seen = tables.keep(source.select("k1", "k2", "text").mapInArrow(pick, "k1 long, k2 int, d1 long, d2 long, n long, at array<int>, keys array<long>"), "picks")
    each = seen.select("k1", "k2", F.posexplode("keys").alias("i", "key")).where("key <> 0")
    alone = each.groupBy("key").agg(F.count("*").alias("c"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("i").alias("i")).where("c = 1")
    copies = seen.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("k1").alias("rep"))
    copied = join_few(seen.select("k1", "k2", "d1", "d2"), copies.where("copies > 1"), ["d1", "d2"], "k1").where("copies is not null")
    marks = alone.select("k1", "k2", "i", F.lit(None).cast("boolean").alias("first")).unionByName(copied.select("k1", "k2", F.lit(None).cast("int").alias("i"), (F.col("k1") == F.col("rep")).alias("first")))
    info = marks.groupBy("k1", "k2").agg(F.collect_list("i").alias("once"), F.max("first").alias("first"))
    rows = seen.drop("d1", "d2", "keys").join(info, ["k1", "k2"], "left")

    def candidates(batches):
        for batch in batches:
            n, first = batch.column("n").to_pylist(), batch.column("first").to_pylist()
            at, once = batch.column("at"), batch.column("once")
            a, b = [], []
            for k in range(batch.num_rows):
                start = np.asarray(at[k].values)
                stop = np.append(start[1:], max(0, n[k] - window + 1))[: len(start)]
                keep = np.ones(len(start), dtype=bool)
                if once[k].is_valid:
                    keep[np.asarray(once[k].values)] = False
                if first[k] is False:
                    keep[:] = False  # the first of the copies stands for all
                a.append(start[keep])
                b.append(stop[keep])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([x is not None for x in first]), _lists(a, pa.int32()), _lists(b, pa.int32())], names=["k1", "k2", "copied", "a", "b"])

    asked = rows.select("k1", "k2", "n", "at", "once", "first").mapInArrow(candidates, "k1 long, k2 int, copied boolean, a array<int>, b array<int>").where("copied or size(a) > 0")
    # Equal rows have equal answers, so one will do.
    asked = tables.keep(asked.dropDuplicates(["k1", "k2"]), "candidates")
    tables.drop(seen)
    held = source.join(asked, ["k1", "k2"], "left")

    def covered(a, b, n: int) -> np.ndarray:
        """Windows that are candidates, as a mask."""
        out = np.zeros(max(0, n - window + 1) + 1, dtype=np.int32)
        np.add.at(out, np.asarray(a, dtype=np.int64), 1)
        np.add.at(out, np.asarray(b, dtype=np.int64), -1)
        return np.cumsum(out)[:-1] > 0

    def sequences(batches):
        for batch in batches:
            words = Words(batch.column("text"), hashes=2)
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            starts, stops = batch.column("a"), batch.column("b")
            at, who, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                if starts[k].is_valid and len(starts[k]):
                    p = np.flatnonzero(covered(starts[k].values, stops[k].values, int(words.first[k + 1] - words.first[k])))
                    at.append(p + words.first[k])
                    who.append(np.full(len(p), k, dtype=np.int64))
                    place.append(p)
            at, who = np.concatenate(at), np.concatenate(who)
            one = window_names(words.hash, window, STEP_NAME)[at].view(np.int64)
            two = (window_names(words.hash2, window, ~STEP_NAME)[at] >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(k1[who]), pa.array(k2[who]), pa.array(np.concatenate(place).astype(np.int32))], names=["h1", "h2", "k1", "k2", "place"])

    def without(batches):
        for batch in batches:
            words = Words(batch.column("text"))
            copied, starts, stops, single = (batch.column(c) for c in ("copied", "a", "b", "single"))
            keep = np.ones(len(words.hash), dtype=bool)
            for k in range(batch.num_rows):
                a, b = int(words.first[k]), int(words.first[k + 1])
                if not copied[k].is_valid or b - a < window:
                    continue
                if copied[k].as_py():
                    keep[a:b] = False
                    continue
                again = covered(starts[k].values, stops[k].values, b - a)
                if single[k].is_valid:
                    again[np.asarray(single[k].values)] = False
                edge = np.zeros(b - a + 1, dtype=np.int32)
                p = np.flatnonzero(again)
                edge[p] += 1
                edge[p + window] -= 1
                keep[a:b] = np.cumsum(edge)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(~keep)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(total[words.first[1:]] - total[words.first[:-1]]), _joined(words, keep)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    # All columns, as below: so Spark deals the texts once for both uses.
    spelled = held.mapInArrow(sequences, "h1 long, h2 int, k1 long, k2 int, place int")
    single = spelled.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("place").alias("place")).where("c = 1")
    single = single.groupBy("k1", "k2").agg(F.collect_list("place").alias("single"))
    ready = held.join(single, ["k1", "k2"], "left").select("doc_id", "text", "copied", "a", "b", "single")
    return ready.mapInArrow(without, "doc_id long, n_words long, n_removed long, kept_text string")
