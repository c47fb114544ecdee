"""Runs of a text: stretches of words that repeat with a period, found over a grammar.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``min_length`` and
2 * q words that no neighbouring word extends keeping that period.

1. Re-Pair over the word ids: the more frequent a pair of neighbours in its document, the sooner it becomes a symbol. A round
   replaces every pair that is more frequent than the pairs it overlaps, so the most frequent one of each document goes
   everywhere at once and all documents of a batch move on together. It ends where no pair occurs twice; what is
   left of a document is then paired up evenly, to one symbol.
2. Each symbol stands for the words of its first place. A run lies across the boundary between the two halves of
   exactly one smallest symbol, so runs across that boundary, inside the symbol, are computed once for each symbol. Periods to
   try come from places in the symbol where three words next to the boundary occur again; how far words stay equal
   at a period is searched with hashes modulo two primes (62 bits).
3. Runs are translated to every place of their symbol in the derivation. Of the same stretch the smallest period counts, of
   stretches with one period the maximal ones: what a symbol's ends cut off is part of a longer stretch found higher up.

All arithmetic is on numpy arrays over some hundred thousand words at a time; Spark deals the rows, nothing is shuffled.

Null, empty and blank texts have no words and no runs, and keep an empty text. Very long texts are read whole. Each row is
judged for itself, also a repeated one or one without doc_id. Overlapping runs all count; a word goes if any run drops it. An
empty table gives an empty result. Other columns stay; one named ``runs``, ``n_words`` or ``kept_text`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, joined_words, mix

#: Words of the documents that make their grammar together, unless one document has more; candidates tried at once.
GROUP_WORDS, CANDIDATES = 300_000, 1 << 18
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 654_435_769))


class Grammar:
    """Rules over words of several documents. Symbols under ``terminals`` are words; symbol x above has the halves
    ``left[x]`` and ``right[x]``, ``size[x]`` words and stands first at word ``place[x]``. ``roots`` has each document's symbol."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        terms = int(ids.max()) + 1 if n else 0
        self.terminals, self.steps = terms, [terms]
        place = np.zeros(terms, dtype=np.int64)
        place[ids[::-1]] = np.arange(n)[::-1]
        none = np.full(terms, -1, dtype=np.int64)
        self._parts = [(none, none, np.ones(terms, dtype=np.int64), place)]
        self._count, self._size = terms, np.ones(terms, dtype=np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self._pair_evenly(*self._re_pair(ids, doc, np.arange(n)))
        self.left, self.right, self.size, self.place = (np.concatenate(x) for x in zip(*self._parts))

    def _rules(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        size = self._size[left] + self._size[right]
        self._parts.append((left, right, size, place))
        self._size = np.concatenate([self._size, size])
        names = np.arange(self._count, self._count + len(left))
        self._count += len(left)
        self.steps.append(self._count)
        return names

    def _re_pair(self, seq: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, documents and places left when no pair of any document occurs twice."""
        done = []
        while len(seq) > 1:
            often = np.bincount(seq, minlength=self._count) > 1
            may = often[seq[:-1]] & often[seq[1:]] & (doc[1:] == doc[:-1])
            equal = seq[1:] == seq[:-1]
            if equal.any():  # of a a a a only every second pair can be replaced
                start = np.maximum.accumulate(np.where(np.concatenate([[True], ~equal]), np.arange(len(seq)), 0))[:-1]
                may &= ~equal | ((np.arange(len(seq) - 1) - start) % 2 == 0)
            spot = np.flatnonzero(may)
            keys, which, count = np.unique(seq[spot] * self._count + seq[spot + 1], return_inverse=True, return_counts=True)
            rank = np.empty(len(keys), dtype=np.int64)
            rank[np.lexsort((mix(keys.astype(np.uint64)), count))] = np.arange(1, len(keys) + 1)
            rank[count < 2] = 0
            power = np.zeros(len(seq) + 1, dtype=np.int64)
            power[spot + 1] = rank[which]
            here = power[1:-1]
            take = np.flatnonzero((here > 0) & (here > power[:-2]) & (here > power[2:]))
            if not len(take):
                break
            pairs, first, name = np.unique(seq[take] * self._count + seq[take + 1], return_index=True, return_inverse=True)
            names = self._rules(pairs // self._count, pairs % self._count, at[take[first]])
            stay = np.ones(len(seq), dtype=bool)
            stay[take + 1] = False
            seq = seq.copy()
            seq[take] = names[name]
            live = np.zeros(int(doc[-1]) + 1, dtype=bool)
            live[doc[take]] = True
            go = live[doc] & stay
            rest = ~live[doc]
            if rest.any():  # documents where no pair occurs twice
                done.append((seq[rest], doc[rest], at[rest]))
            seq, doc, at = seq[go], doc[go], at[go]
        done.append((seq, doc, at))
        seq, doc, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return seq[order], doc[order], at[order]

    def _pair_evenly(self, seq: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        while len(seq):
            begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            if len(begins) == len(seq):
                break
            within = np.arange(len(seq)) - np.repeat(begins, np.diff(np.append(begins, len(seq))))
            take = np.flatnonzero((within[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
            seq[take] = self._rules(seq[take], seq[take + 1], at[take])
            stay = np.ones(len(seq), dtype=bool)
            stay[take + 1] = False
            seq, doc, at = seq[stay], doc[stay], at[stay]
        self.roots, self.root_at = seq, at


class Equal:
    """Are the words from u on and from v on equal? Hashes of any stretch from running sums modulo two primes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        value = mix(ids.astype(np.uint64))
        self.parts = []
        for k, (p, base) in enumerate(PRIMES):
            power = np.ones(1, dtype=np.int64)
            while len(power) < n:
                power = np.concatenate([power, power * (int(power[-1]) * base % p) % p])
            own = ((value >> np.uint64(32 * k)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % p
            self.parts.append((p, power, np.concatenate([[0], np.cumsum(own * power[: n - 1] % p)])))

    def __call__(self, u: np.ndarray, v: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(u), dtype=bool)
        for p, power, total in self.parts:
            same &= (total[u + size] - total[u]) % p * power[v - u] % p == (total[v + size] - total[v]) % p
        return same

    def reach(self, u: np.ndarray, v: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words, up to ``limit``, are equal from u and v on, or (step -1) before u and v."""
        low, high = np.zeros(len(u), dtype=np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            back = mid if step < 0 else 0
            same = self(u - back, v - back, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _crossing(g: Grammar, ids: np.ndarray, doc: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, start, end, period) of runs across the boundary of each symbol, at its first place."""
    none = (np.zeros(0, np.int64),) * 4
    who = np.arange(g.terminals, len(g.size))
    who = who[g.size[who] >= min_length]
    n = len(ids)
    if not len(who) or n < 4:
        return none
    low = g.place[who]
    high, mid = low + g.size[who], low + g.size[g.left[who]]
    # Places of each three words in a row, in order.
    name = mix(mix(mix(ids[:-2].astype(np.uint64)) + ids[1:-1].astype(np.uint64)) + ids[2:].astype(np.uint64))
    spot = np.flatnonzero(doc[2:] == doc[:-2])
    order = spot[np.argsort(name[spot], kind="stable")]
    change = np.concatenate([[True], name[order[1:]] != name[order[:-1]]])
    group = np.full(n, -1, dtype=np.int64)
    group[order] = np.cumsum(change) - 1
    many = np.bincount(group[order]) > 1
    group[order[~many[group[order]]]] = -1
    order = order[group[order] >= 0]
    sorted_at = (group[order] << 32) | order
    equal = Equal(ids)
    out = []
    # To the right: words b and b + q; to the left: words b - q and b. Three equal words lie around or before the boundary.
    for side, shift in ((1, -1), (1, -3), (-1, 0), (-1, -2)):
        x = mid + shift
        fit = np.flatnonzero((x >= low) & (x + 3 <= high))
        fit = fit[group[x[fit]] >= 0]
        key = group[x[fit]] << 32
        if side > 0:
            a, b = np.searchsorted(sorted_at, key | x[fit], side="right"), np.searchsorted(sorted_at, key | np.maximum(high[fit] - 2, 0), side="left")
        else:
            a, b = np.searchsorted(sorted_at, key | low[fit], side="left"), np.searchsorted(sorted_at, key | x[fit], side="left")
        count = np.maximum(b - a, 0)
        stop = np.cumsum(count)
        done, total = 0, int(stop[-1]) if len(stop) else 0
        while done < total:  # candidates by the slice
            till = min(total, done + CANDIDATES)
            flat = np.arange(done, till)
            k = np.searchsorted(stop, flat, side="right")
            y = sorted_at[a[k] + flat - (stop[k] - count[k])] & 0xFFFFFFFF
            s = fit[k]
            q = np.abs(y - x[s])
            u, v = (mid[s], mid[s] + q) if side > 0 else (mid[s] - q, mid[s])
            done = till
            ok = (u >= low[s]) & (v < high[s] + (side > 0))
            s, q, u, v = s[ok], q[ok], u[ok], v[ok]
            # The longer of the two equal stretches has half of what is needed.
            half = (np.maximum(q, min_length - q) + 1) // 2
            ahead, back = v + half <= high[s], u - half >= low[s]
            good = np.zeros(len(s), dtype=bool)
            good[ahead] = equal(u[ahead], v[ahead], half[ahead])
            back &= ~good
            good[back] = equal(u[back] - half[back], v[back] - half[back], half[back])
            s, q, u, v = s[good], q[good], u[good], v[good]
            start = u - equal.reach(u, v, u - low[s], -1)
            end = v + equal.reach(u, v, high[s] - v, 1)
            run = (end - start >= np.maximum(min_length, 2 * q)) & (start < mid[s]) & (end > mid[s])
            out.append((who[s[run]], start[run], end[run], q[run]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def runs_of(ids: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs by start, then period. ``ids`` are word ids of documents that share none; words ``first[k]``
    to ``first[k + 1]`` are document k."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = Grammar(ids, first)
    who, start, end, period = _crossing(g, ids, doc, min_length)
    if not len(who):
        return start, end, period
    # Once each, with its smallest period.
    order = np.lexsort((period, end, start, who))
    who, start, end, period = (x[order] for x in (who, start, end, period))
    keep = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    who, start, end, period = (x[keep] for x in (who, start, end, period))
    has = np.zeros(len(g.size), dtype=bool)
    has[who] = True
    useful = has.copy()
    for a, b in zip(g.steps, g.steps[1:]):
        useful[a:b] |= useful[g.left[a:b]] | useful[g.right[a:b]]
    begin, stop = np.searchsorted(who, np.arange(len(g.size))), np.searchsorted(who, np.arange(len(g.size)), side="right")
    found = []
    symbol, at = g.roots, g.root_at
    while len(symbol):  # down the derivation, where there is something to find
        some = useful[symbol]
        symbol, at = symbol[some], at[some]
        count = stop[symbol] - begin[symbol]
        total = np.cumsum(count)
        row = np.repeat(begin[symbol] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        moved = np.repeat(at - g.place[symbol], count)
        found.append((start[row] + moved, end[row] + moved, period[row]))
        inner = symbol >= g.terminals
        symbol, at = symbol[inner], at[inner]
        symbol, at = np.concatenate([g.left[symbol], g.right[symbol]]), np.concatenate([at, at + g.size[g.left[symbol]]])
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, period = start[keep], end[keep], period[keep]
    # Of one period the maximal stretches: each must reach beyond all that start before it.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    far = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (len(ids) + 1) + end
    keep = np.concatenate([[True], far[1:] > np.maximum.accumulate(far)[:-1]])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start and length in words, and period, by start, then period) and ``kept_text``: the words, joined
    by one blank, without those that a run holds after its first period."""
    if min_length < 6:
        raise ValueError("runs have six words or more: the search starts from three equal words")
    names = [c for c in docs.columns if c not in ("n_words", "runs", "kept_text")]
    source = docs.select(*names)
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("kept_text", T.StringType())])
    at = names.index(text)

    def scan(batches):
        for batch in batches:
            words = Words(batch.column(at))
            first = words.first
            sizes = np.diff(first)
            found, k = [], 0
            drop = np.zeros(len(words.hash) + 1, dtype=np.int64)
            while k < len(sizes):
                z = max(k + 1, int(np.searchsorted(first, first[k] + GROUP_WORDS, side="right")) - 1)
                part = slice(first[k], first[z])
                # Ids of their own for each document's words.
                own = mix(words.hash[part] + mix(np.repeat(np.arange(k, z), sizes[k:z]).astype(np.uint64)))
                ids = np.unique(own, return_inverse=True)[1]
                start, end, period = (x.astype(np.int64) for x in runs_of(ids, first[k : z + 1] - first[k], min_length))
                found.append((start + first[k], end - start, period))
                np.add.at(drop, start + period + first[k], 1)
                np.add.at(drop, end + first[k], -1)
                k = z
            keep = np.cumsum(drop)[:-1] == 0
            start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            cuts = np.searchsorted(start, first)
            start = start - np.repeat(first[:-1], np.diff(cuts))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
            total = np.concatenate([[0], np.cumsum(keep)])
            kept = joined_words(words.data, words.start[keep], words.end[keep], total[first[1:]] - total[first[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs), kept], names=schema.names)

    return source.mapInArrow(scan, schema)


def written(runs: F.Column) -> F.Column:
    """Runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def longest(runs: F.Column) -> F.Column:
    """The run of greatest length; of equals the first, then that of the smallest period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
