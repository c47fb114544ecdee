"""Byte-level BPE encoding and decoding.

Every match of the pre-tokenizer's pattern is encoded by itself. A segment tree over the byte
positions of a piece holds ``rank of the pair that starts here, position``; its root is the
leftmost pair of least rank. A merge writes three leaves (the merged position, its left
neighbour, the position that vanished) and the nodes above them, so it costs a logarithm of the
piece. Short pieces of one size class share a numpy array of trees and merge in step; a long piece
has a tree of its own. Pieces that were met before come from a bounded memo.

Null and empty texts have no ids; very long ones are encoded whole. Pairs of equal rank tie: the leftmost merges first.
Empty tables, repeated rows and extra columns need no care, as the operator only adds columns; one of the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import list_array, safe_chunks

#: Chunks and pieces that a Python worker remembers (some 200 bytes each, so 60 MB); beyond it the memo starts anew.
MEMO = 300_000
#: Longer chunks are not remembered.
MEMO_CHARS = 48
#: Leaves of the trees that merge in step; longer pieces take a tree each.
STEPPED = (4, 8, 16, 32, 64)
_LEAVES = [next(x for x in STEPPED if n <= x) for n in range(STEPPED[-1] + 1)]
FAR = np.iinfo(np.int64).max

_CODERS: dict[str, Coder] = {}


def load_ranks(path: str) -> bytes:
    """The vocabulary file; about a megabyte, so it may travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()

#: Words of letters of unlike case, script and length.
WORDS = ("a", "B", "aB", "Ab", "ABc", "aBCd", "éA", "aÉ", "中a", "a中", "яЯ", "ǅa", "ﬁaʰ", "a" * 300)


class Coder:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        # The libraries' \s is Unicode White_Space; Python's also has four control characters.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # Does the pattern take a word of letters whole, whatever their case and script?
        self.takes_words = all(self.find(b + w) == [b + w] for b in ("", " ") for w in WORDS)
        self.byte_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        get, keys, merged = self.ranks.get, [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None and (b := get(token[cut:])) is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ids = np.array(merged, dtype=np.int64)[order]
        self.pair = None
        self.sizes = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.whole = {token: i.to_bytes(4, "little") for token, i in self.ranks.items()}
        self.memo: dict[str, bytes] = {}

    # -- pieces -------------------------------------------------------------------------------

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that each pair makes, FAR where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ids[at], FAR)

    def _stepped(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Merge many pieces of at most ``leaves`` bytes at once: a row and a tree for each."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = np.full((n, leaves + 1), -1, dtype=np.int64)
        cells = np.arange(leaves)[None, :] < sizes[:, None]
        ids[:, :leaves][cells] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, leaves + 2, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, leaves, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * leaves), FAR, dtype=np.int64)
        rank = self._ranks_of(ids[:, :leaves], ids[:, 1 : leaves + 1])
        tree[:, leaves:] = np.where(rank < FAR, rank * leaves + np.arange(leaves)[None, :], FAR)
        step = leaves
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2
        live = np.flatnonzero(tree[:, 1] < FAR)
        while live.size:
            root = tree[live, 1]
            at = root % leaves
            gone = after[live, at]
            ids[live, at] = root // leaves
            ids[live, gone] = -1
            nxt = after[live, gone]
            after[live, at] = nxt
            inside = nxt <= leaves
            before[live[inside], nxt[inside]] = at[inside]
            right = np.where(nxt < leaves, ids[live, np.minimum(nxt, leaves)], -1)
            self._write(tree, live, at, self._ranks_of(ids[live, at], right), leaves)
            self._write(tree, live, gone, np.full(live.size, FAR), leaves)
            prev = before[live, at]
            has = np.flatnonzero(prev >= 0)
            if has.size:
                rows, p = live[has], prev[has]
                self._write(tree, rows, p, self._ranks_of(ids[rows, p], ids[rows, at[has]]), leaves)
            live = live[tree[live, 1] < FAR]
        kept = ids[:, :leaves] >= 0
        flat, ends = ids[:, :leaves][kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _write(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, leaves: int) -> None:
        node = at + leaves
        tree[rows, node] = np.where(rank < FAR, rank * leaves + at, FAR)
        node = node >> 1
        while node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def _alone(self, piece: bytes) -> bytes:
        """The same with one tree in lists, for a long piece."""
        if self.pair is None:
            self.pair = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist()))
        n, size, pair = len(piece), self.size, self.pair.get
        leaves = 1 << (n - 1).bit_length()
        none = float("inf")
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = pair(ids[i] * size + ids[i + 1])
            if r is not None:
                tree[leaves + i] = r * leaves + i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def write(i: int, rank: int | None) -> None:
            k = leaves + i
            tree[k] = none if rank is None else rank * leaves + i
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] != none:
            rank, i = divmod(tree[1], leaves)
            gone = after[i]
            nxt = after[gone]
            ids[i], ids[gone], after[i] = rank, -1, nxt
            write(gone, None)
            if nxt < n:
                before[nxt] = i
                write(i, pair(rank * size + ids[nxt]))
            else:
                write(i, None)
            if (p := before[i]) >= 0:
                write(p, pair(ids[p] * size + rank))
        return np.array([x for x in ids if x >= 0], dtype="<i4").tobytes()

    def pieces(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of each of the given distinct pieces, as little-endian 32-bit numbers."""
        out: dict[str, bytes] = {}
        classes: dict[int, tuple[list[str], list[bytes]]] = {x: ([], []) for x in STEPPED}
        whole, limit = self.whole, STEPPED[-1]
        for p in new:
            raw = p.encode()
            if raw in whole:
                out[p] = whole[raw]
            elif len(raw) > limit:
                out[p] = self._alone(raw)
            else:
                names, raws = classes[_LEAVES[len(raw)]]
                names.append(p)
                raws.append(raw)
        for leaves, (names, raws) in classes.items():
            for k in range(0, len(names), 8192):
                out.update(zip(names[k : k + 8192], self._stepped(raws[k : k + 8192], leaves)))
        return out

    # -- texts --------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        cut = [safe_chunks(text) if text else [] for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = set(chain.from_iterable(cut)).difference(memo)
        # A word of letters, with or without a blank in front, is one match of most patterns.
        inside = {c: self.find(c) for c in new if not (self.takes_words and (c.isalpha() or (c[0] == " " and c[1:].isalpha())))}
        pieces = set(chain.from_iterable(inside.values()))
        pieces.update(new - inside.keys())
        memo.update(self.pieces(pieces.difference(memo)))
        for c, ps in inside.items():
            memo[c] = b"".join(map(memo.__getitem__, ps))
        found = [b"".join(map(memo.__getitem__, chunks)) for chunks in cut]
        for c in [c for c in pieces.union(new) if len(c) > MEMO_CHARS]:
            del memo[c]
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _coder(ranks_file: bytes, pattern: str) -> Coder:
    """One coder a worker process; building its tables takes half a second."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks_file, pattern)
    return _CODERS[key]


def encoder(df: DataFrame, ranks_path: str, pattern: str):
    """A Column function text -> array<int> of token ids. The vocabulary file is read here and
    broadcast: its size is that of the file, whatever the data."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        coder = _coder(shared.value, pattern)
        found = coder.encode(text.to_pylist())
        return list_array(np.frombuffer(b"".join(found), dtype="<i4"), [len(x) // 4 for x in found], pa.int32())

    return encode


def decoder(df: DataFrame, ranks_path: str, pattern: str):
    """A Column function array<int> -> binary, the bytes that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        coder = _coder(shared.value, pattern)
        flat = np.asarray(ids.flatten())
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.asarray(ids.value_lengths().fill_null(0)), out=at[1:])
        ends = np.concatenate([[0], np.cumsum(coder.sizes[flat])])[at]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(coder.decode(flat.tolist()))]).cast(pa.binary())

    return decode


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array<int>) and ``decoded`` (binary) of a text column."""
    encode, decode = encoder(df, ranks_path, pattern), decoder(df, ranks_path, pattern)
    out = df.withColumn("token_ids", encode(F.col(text)))
    return out.withColumn("decoded", decode(F.col("token_ids")))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))
