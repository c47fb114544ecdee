"""Jaccard self-join on word n-gram sets with prefix trees.

A document's set holds the 64-bit hashes of its distinct n-word shingles. All sets are ordered by one
global order: rarity class of the shingle (from a sketch of counts over all documents, of fixed
size), then hash. Two sets over the threshold share an element among their first few (the prefix).

1. Equal sets are one class, represented by the least doc_id; classes go on alone.
2. Prefix elements, salted by size bucket (sets over the threshold lie in the same or the next one), name
   meeting places. Those with two or more classes elect the least id; places with the same leader are one.
3. At each place sets are screened by signatures, bitmaps of about a bit an element with the parity of
   what falls on each bit: two bitmaps differ in no more bits than their sets in elements. So
   a pair over the threshold is never lost, and sets that met by chance part again before anything
   large is sent. What is left makes candidate clusters.
4. The clusters' whole ordered sets are stored in a prefix tree. A set walks the tree and shares the partial
   overlaps of common beginnings; a subtree is left when the overlap so far plus what can remain is
   too little. Links become stars, stars become components.

No place or cluster is gathered beyond ``BLOCK`` sets: larger ones are split in blocks (``_meet``). Within a
tree, sets that are linked already are not compared again, so a group of near copies costs about its size.

Null, empty and blank texts have empty sets, linked with nothing. A text of fewer than n words is one
shingle; very long texts are read whole. Every row comes back; rows that share a doc_id are looked up by their
own text each, and classes of texts with the same least doc_id count as one. A row without doc_id has the
component of its text, null if no row of that text has an id. Similarities equal to the threshold link. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Tables, join_few
from .words import Words, mix

#: Counters of the sketch of shingle counts: its size bounds what is broadcast (a byte each).
SLOTS = 1 << 20
CHUNKS = 64
#: Sets of a place or cluster that meet at once (a block; the leaders and as many visitors may come in), and elements of the
#: sets or, in the screening, of the sets behind the bitmaps.
BLOCK, ELEMENTS, SCREENED_ELEMENTS = 4096, 2_000_000, 100_000_000
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A to Z count as a to z."""
    words = Words(texts, lower=True)
    h = words.hash
    rolled = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled += h[k : k + len(rolled)] * (FACTORS[k % 5] + np.uint64(2 * (k // 5)))
    rolled = mix(rolled)
    out = []
    for k in range(len(texts)):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = b - a
            for x in h[a:b].tolist():
                short = (short * int(FACTORS[0]) + x) % (1 << 64)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def ordered(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set in global order, as positive longs: rarity class in the five highest bits, then hash."""
    w = weights[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort(((w << np.uint64(58)) | (s >> np.uint64(6))).astype(np.int64))


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """Rarity class of each slot: how often its count doubles the mean. Counts cover all documents."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            slots = [np.zeros(0, np.int64)]
            for s in shingle_sets(batch.column(0), n):
                slots.append((s & np.uint64(SLOTS - 1)).astype(np.int64))
            total += np.bincount(np.concatenate(slots), minlength=SLOTS)
        size = SLOTS // CHUNKS
        blobs = [total[k * size : (k + 1) * size].astype("<u4").tobytes() for k in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(x, dtype="<u4").astype("<i8") for x in table.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    total = np.zeros(SLOTS, dtype=np.int64)
    size = SLOTS // CHUNKS
    for row in parts.toLocalIterator():  # CHUNKS rows whatever the input
        total[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["counts"], dtype="<i8")
    mean = max(1.0, total.sum() / SLOTS)
    return np.minimum(np.floor(np.log2(np.maximum(total / mean, 1.0))), 31).astype(np.uint8)


def need(a: int, b: int, percent: int) -> int:
    """Least overlap by which sets of two sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """A compressed prefix tree of ordered sets (or of their first elements)."""

    __slots__ = ("seg", "kids", "ends", "least", "most", "group")

    def __init__(self, seg: np.ndarray):
        self.seg, self.kids, self.ends = seg, {}, []
        self.least, self.most = 1 << 60, 0
        self.group = -2  # the one component of all sets below, -1 if several

    def insert(self, tokens: np.ndarray, size: int, who: int) -> None:
        node, at = self, 0
        node.least, node.most = min(node.least, size), max(node.most, size)
        while at < len(tokens):
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = Tree(tokens[at:])
                node.kids[int(tokens[at])] = kid
                kid.least = kid.most = size
                kid.ends.append(who)
                return
            seg = kid.seg
            m = min(len(seg), len(tokens) - at)
            same = seg[:m] == tokens[at : at + m]
            k = m if same.all() else int(np.argmin(same))
            if k < len(seg):
                upper = Tree(seg[:k])
                upper.least, upper.most = kid.least, kid.most
                kid.seg = seg[k:]
                upper.kids[int(kid.seg[0])] = kid
                node.kids[int(upper.seg[0])] = upper
                kid = upper
            kid.least, kid.most = min(kid.least, size), max(kid.most, size)
            node, at = kid, at + k
        node.ends.append(who)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def tree_join(sizes: list[int], lists: list[np.ndarray], percent: int, side: list[int] | None = None) -> Union:
    """Union of all pairs whose overlap can reach the threshold, judged by the given beginnings of the
    ordered sets; with whole sets that is exact. ``side``: only pairs of unlike sides are compared."""
    n = len(sizes)
    union = Union(n)
    vocabulary, flat = np.unique(np.concatenate(lists), return_inverse=True)
    cuts = np.cumsum([0, *map(len, lists)])
    local = [flat[cuts[k] : cuts[k + 1]] for k in range(n)]
    whole = [len(lists[k]) == sizes[k] for k in range(n)]
    root = Tree(np.zeros(0, dtype=np.int64))
    has = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for x in sorted(range(n), key=lambda k: sizes[k]):
        mine, size = local[x], sizes[x]
        # How many of the set's elements are at most each element: what is used up at that point.
        has[:] = 0
        has[mine + 1] = 1
        used = np.cumsum(has)
        last = int(mine[-1]) if not whole[x] else len(vocabulary)
        todo = [(kid, 0, 0) for kid in root.kids.values()]
        while todo:
            node, overlap, depth = todo.pop()
            if need(size, max(node.least, 1), percent) > min(size, node.most):
                continue
            seg = node.seg
            stop = len(seg) if seg[-1] <= last else int(np.searchsorted(seg, last, side="right"))
            if stop:
                overlap += int((used[seg[:stop] + 1] - used[seg[:stop]]).sum())
            depth += stop
            z = int(seg[stop - 1]) if stop else None
            spent = int(used[min(last, z) + 1]) if z is not None else 0
            if stop < len(seg):
                spent = int(used[last + 1]) if last < len(vocabulary) else size
            bound = overlap + min(size - spent, node.most - depth)
            if bound < need(size, node.least, percent):
                continue
            if stop < len(seg):  # beyond what is known of this set: all below may reach it
                below = [node]
                while below:
                    b = below.pop()
                    below.extend(b.kids.values())
                    for y in b.ends:
                        if overlap + min(size - spent, sizes[y] - depth) >= need(size, sizes[y], percent) and (side is None or side[x] != side[y]):
                            union.join(x, y)
                continue
            for y in node.ends:
                if union.find(x) != union.find(y) and (side is None or side[x] != side[y]):
                    rest = 0 if whole[y] else min(size - spent, sizes[y] - depth)
                    if overlap + rest >= need(size, sizes[y], percent):
                        union.join(x, y)
            if node.kids:
                mine_root = union.find(x)
                todo.extend((kid, overlap, depth) for kid in node.kids.values() if not (not kid.kids and len(kid.ends) == 1 and union.find(kid.ends[0]) == mine_root))
        root.insert(mine, size, x)
    return union


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def signature(s: np.ndarray) -> bytes:
    """Parities of a set's elements on a power of two of bits, at least one an element."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    at = ((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def screen(sizes: list[int], signatures: list[bytes], percent: int, side: list[int] | None = None) -> list[int]:
    """For each set the first one of its group, where groups join all pairs that may reach the threshold."""
    n = len(sizes)
    order = np.argsort(np.array(sizes), kind="stable")
    size = np.array(sizes, dtype=np.int64)[order]
    sides = None if side is None else np.array(side)[order]
    group = np.arange(n)
    by_width: dict[int, list[int]] = {}
    for k, at in enumerate(order.tolist()):
        by_width.setdefault(len(signatures[at]), []).append(k)
    tables = {}
    for width, rows in by_width.items():
        flat = np.frombuffer(b"".join(signatures[int(order[k])] for k in rows), dtype=np.uint64).reshape(len(rows), -1)
        tables[width] = (np.array(rows, dtype=np.int64), flat)
    for width, (rows, flat) in tables.items():
        near = [(rows, flat)]
        if 2 * width in tables:  # the next class, folded to this width
            wide, more = tables[2 * width]
            near.append((wide, more[:, : more.shape[1] // 2] ^ more[:, more.shape[1] // 2 :]))
        for i, x in enumerate(rows.tolist()):
            for others, bits in near:
                a = np.searchsorted(others, x, side="right")
                b = np.searchsorted(size[others], size[x] * 100 // percent, side="right")
                if a >= b:
                    continue
                y = others[a:b]
                least = -(-percent * (size[x] + size[y]) // (100 + percent))
                close = np.bitwise_count(bits[a:b] ^ flat[i]).sum(axis=1, dtype=np.int64) <= size[x] + size[y] - 2 * least
                if sides is not None:
                    close &= sides[y] != sides[x]
                if close.any():
                    joined = np.unique(np.append(group[y[close]], group[x]))
                    if len(joined) > 1:
                        group[np.isin(group, joined)] = joined[0]
    out = [0] * n
    for k, at in enumerate(order.tolist()):
        out[at] = int(order[group[k]])
    return out


def _joined(rows: DataFrame, payload: str, join) -> DataFrame:
    """Edges (a, b) that ``join`` finds in each cell (place, i, j); where rows of side 1 come in, they meet those of side 0 only."""
    rows = rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")

    def run(batches):
        for t in grouped(batches, 3):
            ids, sizes, sides = (t.column(c).to_pylist() for c in ("id", "n", "side"))
            if len(ids) < 2:
                continue
            firsts = join(sizes, t.column(payload).combine_chunks(), sides if 1 in sides else None)
            pairs = [(ids[x], ids[r]) for x, r in enumerate(firsts) if ids[r] != ids[x]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _meet(members: DataFrame, payload: str, join, tables: Tables, elements: int) -> DataFrame:
    """Edges (a, b) such that ``join`` links, directly or by way of others, all pairs at a place that it finds. members: place,
    id, n, payload.

    A place of over BLOCK sets or ``elements`` elements is dealt over blocks. In each block its sets meet each other and a few
    leaders, the same ones in all blocks of the place, so near copies make one group over all blocks. Pairs within the
    largest group of a place are linked then; only the sets outside it still go to every block, to meet the sets there."""
    masks = [0, (1 << 63) - 1, 0x5555555555555555, 0x3333333333333333]
    count = members.groupBy("place").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), *[F.min(F.col("id").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(masks)]).where("members > 1")
    blocks = F.least(F.col("members"), F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("elements") / elements))).cast("int").alias("blocks")
    leaders = F.array_distinct(F.array(*[F.col(f"m{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(masks)])).alias("leaders")
    places = tables.keep(count.select("place", "members", blocks, leaders), "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = members.join(places, "place").withColumn("block", block)
    # A leader goes to every block, any other set to its own.
    to = F.when((F.col("blocks") > 1) & F.array_contains("leaders", F.col("id")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    home = held.select("place", F.explode(to).alias("i"), F.lit(0).alias("j"), "id", "n", payload, F.lit(0).alias("side"))
    if places.where("blocks > 1").isEmpty():
        return _joined(home, payload, join)
    first = tables.keep(_joined(home, payload, join), "links")
    groups = components(first, tables)
    named = held.where("blocks > 1").select("place", "id", "blocks").join(groups, "id", "left").select("place", "id", "blocks", F.coalesce("component", "id").alias("group"))
    largest = named.groupBy("place", "group").agg(F.count("*").alias("size")).groupBy("place").agg(F.max_by("group", F.struct("size", "group")).alias("largest"))
    rest = tables.keep(named.join(largest, "place").where("group <> largest").select("place", "id", "blocks"), "rest")
    rounds = rest.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rounds"))
    once = held.where("blocks > 1").join(rounds, "place")
    stay = once.select("place", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("j"), "id", "n", payload, F.lit(0).alias("side"))
    visit = once.join(rest.select("place", "id"), ["place", "id"], "left_semi")
    visit = visit.select("place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("rounds")).cast("int").alias("j"), "id", "n", payload, F.lit(1).alias("side"))
    return first.unionByName(_joined(stay.unionByName(visit), payload, join))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its set and the least doc_id that
    links of at least ``percent`` per cent Jaccard similarity reach."""
    if not 50 < percent <= 100:
        raise ValueError("percent lies over 50 and up to 100: size buckets and signatures count on it")
    spark = docs.sparkSession
    tables = Tables(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights = spark.sparkContext.broadcast(rarity(source, n))  # SLOTS bytes

    def prefixes(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), n)
            first, size, one, two, marks = [], [], [], [], []
            for s in sets:
                k = len(s)
                size.append(k)
                first.append(ordered(s, weights.value)[: k - -(-percent * k // 100) + 1] if k else np.zeros(0, np.int64))
                marks.append(signature(s))
                one.append(mix(s).sum(dtype=np.uint64))
                two.append(mix(s ^ FACTORS[1]).sum(dtype=np.uint64))
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), tokens, pa.array(marks, pa.binary())], names=["doc_id", "n", "d1", "d2", "tokens", "mark"])

    hashed = tables.keep(source.mapInArrow(prefixes, "doc_id long, n long, d1 long, d2 long, tokens array<long>, mark binary"), "prefixes")
    classes = hashed.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = hashed.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").where("n > 0").select(F.col("doc_id").alias("id"), "n", "tokens", "mark")
    reps = tables.keep(reps, "classes")
    seen = tables.keep(hashed.select("doc_id", "n", "d1", "d2"), "sizes")
    tables.drop(hashed)
    classes = seen.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    bucket = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    short = (F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1).cast("int")
    own = F.transform("tokens", lambda t: F.struct(F.xxhash64(t, bucket).alias("key"), F.lit(True).alias("home")))
    # The smaller set of a pair needs fewer elements in its prefix; it also calls at the next bucket.
    guest = F.transform(F.slice("tokens", 1, short + 1), lambda t: F.struct(F.xxhash64(t, bucket + 1).alias("key"), F.lit(False).alias("home")))
    calls = reps.select("id", F.explode(F.concat(own, guest)).alias("c")).select("id", "c.key", "c.home")
    leaders = calls.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("most"), F.bool_or("home").alias("home")).where("home and leader < most").select("key", "leader")
    places = tables.keep(calls.join(leaders, "key").select("id", "leader").distinct(), "places")

    def screened(sizes, marks, side):
        return screen(sizes, marks.to_pylist(), percent, side)

    met = places.join(reps.select("id", "n", "mark"), "id").withColumnRenamed("leader", "place")
    clusters = components(_meet(met, "mark", screened, tables, SCREENED_ELEMENTS), tables)

    def whole(batches):
        for batch in batches:
            sets = [ordered(s, weights.value) for s in shingle_sets(batch.column(2), n)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), tokens], names=["place", "id", "n", "tokens"])

    asked = clusters.select(F.col("id").alias("doc_id"), "component")
    sets = source.join(asked, "doc_id").select("component", "doc_id", "text").mapInArrow(whole, "place long, id long, n long, tokens array<long>").where("n > 0")
    sets = tables.keep(sets, "sets")
    tables.drop(reps, places, clusters)

    def verified(sizes, tokens, side):
        flat, cuts = np.asarray(tokens.flatten()), np.asarray(tokens.offsets)
        cuts = cuts - cuts[0]
        union = tree_join(sizes, [flat[a:b] for a, b in zip(cuts, cuts[1:])], percent, side)
        return [union.find(x) for x in range(len(sizes))]

    found = components(_meet(sets, "tokens", verified, tables, ELEMENTS), tables)
    tables.drop(sets)
    linked = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "copies", "rep", F.coalesce("component", "rep").alias("component_id"))
    # A text that occurs once and is linked with nothing needs no row here.
    few = linked.where("copies > 1 or component_id <> rep").drop("rep")
    return join_few(seen, few, ["d1", "d2"], "doc_id").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
