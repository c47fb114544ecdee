"""Similarity of two texts as sequences of characters: the ratio of ``difflib.SequenceMatcher``, and a bound above it.

difflib looks for the longest block of equal characters, then left and right of it; in texts of 200 characters or more it starts blocks
from characters only that make up at most a hundredth of the second text, and lets them grow over the others. It walks the whole
range for every block. Here the stretches of such characters that both texts share are found once, in numpy, and kept by length; each range
then looks only at the first of its own, so work follows the number of shared stretches instead of ranges times text.
(A suffix automaton of the second text does not serve: blocks have to lie within ranges of it.)
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np

#: Fixed values of the rule for frequent characters: least length of the second text, its share.
POPULAR_FROM, POPULAR_PART = 200, 100
#: Pairs of equal characters over which texts go to difflib, which takes longer and no memory; stretches from which numpy is faster.
MOST_PAIRS, FEW = 8_000_000, 48
#: Characters of a gram.
GRAM = 6


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _stretches(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(begin in a, begin in b, length) of the maximal equal stretches of characters that may start a block, the longest first, then by their places; None if
    there are too many."""
    x, y = codes(a), codes(b)
    order = np.argsort(y if y.max() >> 16 else y.astype(np.uint16), kind="stable")  # numpy sorts short integers in one pass
    begin = np.flatnonzero(np.diff(y[order], prepend=~y[order[:1]]))
    known, count = y[order[begin]], np.diff(np.append(begin, len(y)))
    good = count <= len(b) // POPULAR_PART + 1 if len(b) >= POPULAR_FROM else np.ones(len(known), dtype=bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    i = np.flatnonzero((known[at] == x) & good[at])
    size = count[at[i]]
    total = int(size.sum())
    if total > MOST_PAIRS:
        return None
    stop = np.cumsum(size)
    j = order[np.repeat(begin[at[i]] - (stop - size), size) + np.arange(total)]
    i = np.repeat(i, size)
    if not total:
        return i, j, np.zeros(0, np.int64)
    wide, high = len(a).bit_length(), len(b).bit_length()
    met = np.sort((i - j + len(b) << wide) | i)  # by diagonal, then by place: the next pair of a stretch is one more
    first = np.flatnonzero(np.diff(met, prepend=-1) != 1)
    n = np.diff(np.append(first, total))
    i = met[first] & (1 << wide) - 1
    j = i - (met[first] >> wide) + len(b)
    if 2 * wide + high > 62:
        by = np.lexsort((j, i, -n))
        return i[by], j[by], n[by]
    by = np.sort((len(a) - n << wide + high) | (i << high) | j)
    return by >> high & (1 << wide) - 1, by & (1 << high) - 1, len(a) - (by >> wide + high)


def _ahead(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters from i and j on are equal."""
    n, step = 0, 16
    while n < most:
        size = min(step, most - n)
        if a[i + n : i + n + size] == b[j + n : j + n + size]:
            n += size
            step *= 2
        elif size == 1:
            break
        else:
            step = max(1, size // 2)
            most = min(most, n + size)
    return n


def _behind(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters before i and j are equal."""
    n, step = 0, 16
    while n < most:
        size = min(step, most - n)
        if a[i - n - size : i - n] == b[j - n - size : j - n]:
            n += size
            step *= 2
        elif size == 1:
            break
        else:
            step = max(1, size // 2)
            most = min(most, n + size)
    return n


def _longest(held, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(begin in a, begin in b, length) of the longest part within a range, the first of several. The longest stretches stand first, so the search ends at
    the first that lies within the range as a whole; those before it are cut by the range's ends, and few."""
    i, j, k = alo, blo, 0
    for p, q, n in _in_turn(held) if isinstance(held, tuple) else held:
        if n < k:
            break
        if p >= alo and q >= blo and p + n <= ahi and q + n <= bhi:
            if n > k or (p, q) < (i, j):
                i, j, k = p, q, n
            break
        skip = max(alo - p, blo - q, 0)
        size = min(ahi - p, bhi - q, n) - skip
        if size > k or (size == k and k and (p + skip, q + skip) < (i, j)):
            i, j, k = p + skip, q + skip, size
    return i, j, k


def _in_turn(held: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """The stretches one after the other, taken from the arrays 8, 16, 32, ... at a time."""
    at, step = 0, 8
    while at < len(held[0]):
        yield from zip(*(x[at : at + step].tolist() for x in held))
        at, step = at + step, 2 * step


def matching(a: str, b: str, least: int = 0) -> int:
    """Characters of all matching blocks; -1 as soon as what is left of both texts cannot make them ``least``."""
    found = _stretches(a, b)
    if found is None:
        if least and not common_at_least(a, b, least):
            return -1
        return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    total, may = 0, min(len(a), len(b))
    todo = [(0, len(a), 0, len(b), found if len(found[0]) > FEW else list(zip(*(x.tolist() for x in found))))]
    while todo:
        if total + may < least:
            return -1
        alo, ahi, blo, bhi, held = todo.pop()
        may -= _most(alo, ahi, blo, bhi, held)
        i, j, k = _longest(held, alo, ahi, blo, bhi)
        if k:
            back = _behind(a, b, i, j, min(i - alo, j - blo))
            i, j, k = i - back, j - back, k + back
        k += _ahead(a, b, i + k, j + k, min(ahi - i - k, bhi - j - k))
        if not k:
            continue
        total += k
        left, right = alo < i and blo < j, i + k < ahi and j + k < bhi
        if isinstance(held, tuple):
            si, sj, sl = held
            if left:
                some = (si < i) & (sj < j)
                todo.append((alo, i, blo, j, _few(si[some], sj[some], sl[some])))
                may += _most(*todo[-1])
            if right:
                some = (si + sl > i + k) & (sj + sl > j + k)
                todo.append((i + k, ahi, j + k, bhi, _few(si[some], sj[some], sl[some])))
                may += _most(*todo[-1])
        else:
            if left:
                todo.append((alo, i, blo, j, [s for s in held if s[0] < i and s[1] < j]))
                may += _most(*todo[-1])
            if right:
                todo.append((i + k, ahi, j + k, bhi, [s for s in held if s[0] + s[2] > i + k and s[1] + s[2] > j + k]))
                may += _most(*todo[-1])
    return total if total >= least else -1


def _most(alo: int, ahi: int, blo: int, bhi: int, held) -> int:
    """What may match within a range: nothing without a stretch, but at the beginning of both texts. Elsewhere a range begins behind a block, where
    characters differ."""
    return min(ahi - alo, bhi - blo) if not alo or len(held[0] if isinstance(held, tuple) else held) else 0


def _few(si: np.ndarray, sj: np.ndarray, sl: np.ndarray):
    return (si, sj, sl) if len(si) > FEW else list(zip(si.tolist(), sj.tolist(), sl.tolist()))


def ratio(a: str | None, b: str | None) -> float:
    """Twice the matching characters over all characters, order of the arguments kept; 0 if either text is empty."""
    if not a or not b:
        return 0.0
    if a == b:  # the first of the longest blocks then lies at the same place in both and grows over all
        return 1.0
    return 2.0 * matching(a, b) / (len(a) + len(b))


def ratio_at_least(a: str, b: str, low: float) -> float | None:
    """The ratio of two texts if it is at least ``low``, else null."""
    if a == b:
        return 1.0
    found = matching(a, b, max(0, math.ceil(low * (len(a) + len(b)) / 2 - 1e-9)))
    return 2.0 * found / (len(a) + len(b)) if found >= 0 else None


def grams(text: str) -> np.ndarray:
    """Sorted hashes of all stretches of GRAM characters."""
    x = codes(text)
    h = np.zeros(max(0, len(x) - GRAM + 1), dtype=np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x9E3779B1) + x[k : k + len(h)]
    return np.sort(h)


def hashes(text: str, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` characters, in their order; the upper bits are mixed."""
    x = codes(text)
    h = np.zeros(max(0, len(x) - size + 1), dtype=np.uint32)
    for k in range(size):
        h += x[k : k + len(h)]
        h *= np.uint32(0x9E3779B1)
    return h


def starters(b: str) -> int:
    """How many characters of the second text may start a block."""
    if len(b) < POPULAR_FROM:
        return len(b)
    x = codes(b)
    count = np.unique(x, return_counts=True)[1] if x.max() >> 16 else np.bincount(x)
    return int(count[count <= len(b) // POPULAR_PART + 1].sum())


def gram_slack(b: str, size: int = GRAM) -> int:
    """By how much the grams of ``size`` characters that two texts share may fall short of their matching characters, if ``b`` is the second text. A block of n
    characters holds n - size + 1 grams. Each block holds a character that may start one, but for one block at the beginning of both texts; blocks do
    not overlap, so they are at most one more than such characters."""
    return (size - 1) * (starters(b) + 1)


def common_at_least(a: str, b: str, need: int) -> bool:
    """Do the texts have a common subsequence of ``need`` characters? Matching blocks make one, so without it the ratio is
    lower. One row of the table is an integer of a bit a character; it ends when what is left cannot suffice."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for k, c in enumerate(b):
        m = row & where.get(c, 0)
        row = ((row + m) | (row - m)) & full
        if not k & 63 and len(a) - row.bit_count() + len(b) - k - 1 < need:
            return False
    return len(a) - row.bit_count() >= need
