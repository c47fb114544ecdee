"""Word hashes of an Arrow batch, in numpy over the UTF-8 bytes.

A word is a run of bytes other than blank and ``\\t\\n\\x0b\\x0c\\r``, or other than those that the caller names. Its hash
mixes eight bytes after another, so words of one pattern, however regular, do not share hashes, and no Python object
is made per word.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once; temporary arrays take some 20 times as much.
STEP = 1 << 18
#: Bytes from which a word is hashed by the library, on its own.
LONG = 512
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if k not in _POWERS or len(_POWERS[k][0]) < size:
        size = max(size, 2 * STEP)
        base = int(BASES[k])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            f = np.full(size, b, dtype=np.uint64)
            f[0] = 1
            both.append(np.multiply.accumulate(f))
        _POWERS[k] = (both[0], both[1])
    return _POWERS[k]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: int) -> list[np.ndarray]:
    """``hashes`` (one or two) unlike hashes of each ``data[start:end]``."""
    room = np.zeros(len(data) + 8, dtype=np.uint8)
    room[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=room.data, strides=(1,))
    size = end - start
    out = [size.astype(np.uint64) * BASES[1 - k] + BASES[k] for k in range(hashes)]
    rest = np.flatnonzero(size < LONG)
    j = 0
    while rest.size:
        left = size[rest] - j
        part = eight[start[rest] + j]
        short = np.flatnonzero(left < 8)
        part[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        for k in range(hashes):
            out[k][rest] = mix(out[k][rest] ^ part) * BASES[k] + np.uint64(1)
        rest = rest[left > 8]
        j += 8
    for i in np.flatnonzero(size >= LONG).tolist():
        digest = blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        for k in range(hashes):
            out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return [mix(h) for h in out]


class Words:
    """Words of a batch: ``hash`` and ``start``/``end`` (byte offsets into ``data``) of each word, and
    ``first``, the index of each document's first word with the total behind."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: int = 1, separator: np.ndarray = SEPARATOR):
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
        at = at - at[0]
        self.data, self.doc_at = raw, at
        starts, ends, found = [], [], [[] for _ in range(hashes)]
        a = 0
        while a < len(raw):
            b = min(a + STEP, len(raw))
            while b < len(raw):  # on to the end of the word
                stop = np.flatnonzero(separator[raw[b : b + STEP]])
                if stop.size:
                    b += int(stop[0])
                    break
                b = min(b + STEP, len(raw))
            part = raw[a:b]
            word = ~separator[part]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            closes = word.copy()
            closes[:-1] &= ~word[1:]
            cut = at[(at > a) & (at < b)] - a
            begins[cut] = word[cut]
            closes[cut - 1] = word[cut - 1]
            s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
            for k, h in enumerate(hash_spans(LOWER[part] if lower else part, s, e, hashes)):
                found[k].append(h)
            starts.append(s + a)
            ends.append(e + a)
            a = b
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end = cat(starts, np.int64), cat(ends, np.int64)
        self.hash = cat(found[0], np.uint64)
        self.hash2 = cat(found[1], np.uint64) if hashes > 1 else None
        self.first = np.searchsorted(self.start, at, side="left")

    def of(self, k: int) -> slice:
        return slice(self.first[k], self.first[k + 1])


def joined_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ``counts`` words each, ``data[s:e]`` in order, joined by one blank."""
    size = e - s + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    step = 1 << 16
    for k in range(0, len(s), step):
        a, z, b = s[k : k + step], size[k : k + step], stop[k : k + step]
        base = b[0] - z[0]
        at = np.arange(base, b[-1]) - np.repeat(b - z, z)
        body = at < np.repeat(z - 1, z)
        out[base : b[-1]][body] = data[(np.repeat(a, z) + at)[body]]
    ends = np.concatenate([[0], np.cumsum(counts)])
    byte_at = np.concatenate([[0], stop])[ends]
    # Each document's last blank goes.
    out = np.delete(out, byte_at[1:][counts > 0] - 1)
    offsets = byte_at - np.concatenate([[0], np.cumsum(counts > 0)])
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
