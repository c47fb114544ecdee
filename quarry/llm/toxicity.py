"""Toxicity scores behind a noisy-channel deobfuscator.

1. Trigrams of characters are counted over all documents (numpy per Arrow batch, summed by Spark);
   the alphabet is fixed, so the table has the same size for any corpus.
2. A token that may be disguised (digits or signs between letters, letters of two scripts, full-width letters, loose
   accents, a letter three times in a row, letters spaced out) becomes a lattice: each character may stand for itself or for the letter it
   looks like, a repeated one or a separator may vanish. Viterbi finds the path that the channel and the
   character model find likeliest. Other tokens have one path and stay.
3. Features of the restored text are its words, their beginnings of 4 and 5 letters and ends of 5. Their
   counts with and without the label come from a sample of labelled rows, at most ``TRAIN_ROWS``;
   the log-odds of the strongest words of a document go through a logistic function that is
   fitted on the same rows, each without its own count.

Rows with ``crc32(doc_id as text) % 5 = 0`` are held out: no label of theirs is read. doc_id only
chooses rows (one without doc_id is never learned from; ``fold`` of it is null); scores depend on texts alone. Null and empty texts have no features and get the score of
that; without any labelled row all scores are 0. Very long texts are read whole; the score of a text is that of its eight
strongest words, so it does not grow with length. Words that tie count alike. Repeated rows are scored each, an empty
table gives an empty result; extra columns stay, except one named ``toxicity``.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows from which the classifier is fitted, at most; taken in the order of a hash.
TRAIN_ROWS = 20_000
#: Documents of the sample that a feature needs. All that pass are kept; the sample bounds their number.
LEAST_DOCS = 4
#: Words that a score is made from: the strongest few one by one, the next ones by their sum.
SINGLE, STRONGEST = 3, 8
#: Words that a worker remembers (some 150 bytes each).
MEMO = 400_000
#: Longer tokens are restored each time.
MEMO_CHARS = 64

#: Characters of the model: 0 boundary, 1-26 letters, 27 any other letter, 28 digits, 29 the rest.
ALPHABET = 30
_CLASS = np.full(0x300, 29, dtype=np.int64)
for _c in range(0x300):
    _s = chr(_c).lower()[0]
    _CLASS[_c] = ord(_s) - 96 if "a" <= _s <= "z" else 27 if _s.isalpha() else 28 if _s.isdigit() else 0 if _s.isspace() else 29

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("авеіјкмнорсԛѕтухһԁԝαειικνορτυχγωվոսհ", "abeijkmhopcqstyxhdwaeiiknoptuxywunuh"))
_SEPARATORS = ".-_*~ '`/"
_NOISY = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][0-9@$!|+€£(<*._~-]+[^\W\d_]|[0-9@$!|+€£][0-9@$!|+€£]*[^\W\d_]{2}|.*(.)\1\1)", re.S)
#: Letters of two scripts, full-width letters or loose accents in one word.
_MIXED = re.compile(rf"(?=.*[a-z\uff41-\uff5a])(?:.*[{''.join(ALIKE)}\uff41-\uff5a\u0300-\u036f])", re.S)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\W_])")
_DOUBLE, _SINGLE = re.compile(r"  +"), re.compile(r"[^\W_] [^\W_]")
_REPEATED = re.compile(r"(.)\1\1", re.S)
_EDGE = ".,;:!?\"()[]{}*%$&#|<>'"


def char_class(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x300, _CLASS[np.minimum(points, 0x2FF)], 27)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """ALPHABET x ALPHABET x ALPHABET counts over all texts. What reaches the driver is that table."""

    def count(batches):
        total = np.zeros(ALPHABET**3, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k in range(0, len(t or ""), 1 << 20):
                    c = char_class(" " + t[max(0, k - 1) : k + (1 << 20)] + " ")
                    total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    out = np.zeros(ALPHABET**3)
    for row in docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and unigram."""
    uni = counts.sum((0, 1)) + 1.0
    bi = counts.sum(0) + 1e-9
    p1 = uni / uni.sum()
    p2 = 0.9 * bi / bi.sum(1, keepdims=True) + 0.1 * p1[None, :]
    tri = counts.sum(2, keepdims=True)
    lam = tri / (tri + 5.0)
    return np.log(lam * counts / np.maximum(tri, 1) + (1 - lam) * p2[None, :, :])


class Restorer:
    """Viterbi over the lattice of a disguised token."""

    SAME, LOOKS, DROPPED_REPEAT, DROPPED_MARK, LEFT_SIGN = 0.0, -1.0, -1.2, -0.7, -4.0

    def __init__(self, model: np.ndarray):
        self.lp = model.tolist()
        self.memo: dict[str, str] = {}

    @staticmethod
    def _kind(c: str) -> int:
        return int(_CLASS[ord(c)]) if ord(c) < 0x300 else 27

    def _paths(self, token: str, k: int, repeated: set[str]) -> list[tuple[str, float]]:
        c = token[k]
        if c in _SEPARATORS or "\u0300" <= c <= "\u036f":
            return [("", self.DROPPED_MARK), (c, self.LEFT_SIGN)]
        ways = [(c, self.SAME if c.isalpha() else self.LEFT_SIGN)]
        ways += [(x, self.LOOKS) for x in LOOKALIKES.get(c, ALIKE.get(c, ""))]
        if k and token[k - 1] == c and c in repeated:
            ways.append(("", self.DROPPED_REPEAT))
        return ways

    def token(self, token: str) -> str:
        """The likeliest reading of a whole token; paths are linked back, so the work is linear in its length."""
        token = token.lower()
        if not token.isascii():
            token = unicodedata.normalize("NFKD", token)  # full-width letters become plain ones, accents may go
        if token in self.memo:
            return self.memo[token]
        repeated = {m[0][0] for m in _REPEATED.finditer(token)}
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for k in range(len(token)):
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            ways = [(c, cost, self._kind(c) if c else 0) for c, cost in self._paths(token, k, repeated)]
            for (a, b, last), (score, path) in states.items():
                for c, cost, z in ways:
                    key, value = ((b, z, c), score + cost + self.lp[a][b][z]) if c else ((a, b, last), score + cost)
                    if key not in nxt or value > nxt[key][0]:
                        nxt[key] = (value, (path, c) if c else path)
            states = nxt
        path = max((score + self.lp[a][b][0], key) for key in states for (a, b, _), (score, _) in [(key, states[key])])[1]
        path, out = states[path][1], []
        while path is not None:
            path, c = path
            out.append(c)
        best = unicodedata.normalize("NFC", "".join(reversed(out)))
        if len(token) <= MEMO_CHARS:
            if len(self.memo) > MEMO // 10:
                self.memo.clear()
            self.memo[token] = best
        return best

    def spaced(self, text: str, parts: bool = False) -> str:
        """The text with spaced-out runs restored. With ``parts``, a double blank in a run of single ones ends a word, and
        the words between such blanks are restored on their own too."""

        def run(m: re.Match) -> str:
            words = _DOUBLE.split(m[0]) if parts and _SINGLE.search(m[0]) else []
            return f" {self.token(m[0])} " + "".join(f"{self.token(w)} " for w in words if len(words) > 1)

        return _SPACED.sub(run, text)

    def text(self, text: str) -> str:
        """The text in lower case with disguised tokens restored."""
        return " ".join(self.words(self.spaced(text)))

    def words(self, text: str) -> list[str]:
        out = []
        for w in text.lower().split():
            if not w.isascii() and _MIXED.match(w):
                out.append(self.token(w.strip(_EDGE)).strip(_EDGE))
                continue
            if w.isalpha():
                out.append(w)
                continue
            bare = w.strip(_EDGE)
            lead = w.rstrip(".,;:?\"'")
            if bare.isalpha() and (lead[:1] not in LOOKALIKES or lead[:1] in "(<!|"):
                out.append(bare)
            elif lead and _NOISY.match(lead):
                out.append(self.token(lead).strip(_EDGE))
            elif bare:
                out.append(bare)
        return out

    def restored_words(self, text: str) -> set[str]:
        words = set(self.words(self.spaced(text, parts=True)))
        for w in [w for w in words if _REPEATED.search(w)]:
            words.add(self.token(w))
        return words


def word_features(word: str) -> list[int]:
    """Hashes of a word, of its beginnings and of its end."""
    names = [word] + [f"{word[:n]}*" for n in (4, 5) if len(word) > n] + ([f"*{word[-5:]}"] if len(word) > 5 else [])
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in names]


def doc_features(restorer: Restorer, text: str | None) -> set[int]:
    return {f for w in restorer.restored_words(text or "") for f in word_features(w)}


def word_strengths(restorer: Restorer, text: str | None, weight: dict[int, float]) -> list[float]:
    """The strongest feature of each distinct word that has one."""
    best = (max((weight.get(f, 0.0) for f in word_features(w)), default=0.0) for w in restorer.restored_words(text or ""))
    return [x for x in best if x]


def strength(n: np.ndarray, pos: np.ndarray, base: float) -> np.ndarray:
    """Cautious log-odds of the label given a feature, above those of the corpus."""
    p = np.minimum((pos + 2.0 * base) / (n + 2.0), 1.0)
    p = np.clip(p - 0.5 * np.sqrt(p * (1 - p) / np.maximum(n, 1)), 1e-6, 1 - 1e-3)
    return np.maximum(np.log(p / (1 - p)) - math.log(base / (1 - base)), 0.0)


def _summary(values: list[float]) -> list[float]:
    """What the logistic function sees: the three strongest words and the sum of the next ones."""
    top = sorted(values, reverse=True)[:STRONGEST] + [0.0] * SINGLE
    return [*top[:SINGLE], sum(top[SINGLE:])]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, model: np.ndarray, hashes: np.ndarray, weights: np.ndarray, logistic: np.ndarray):
        self.restorer = Restorer(model)
        self.weight = dict(zip(hashes.tolist(), weights.tolist()))
        self.logistic = logistic.tolist()
        self.memo: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        values: list[float] = []
        memo, weight = self.memo, self.weight
        for w in self.restorer.restored_words(text or ""):
            got = memo.get(w)
            if got is None:
                got = max(weight.get(f, 0.0) for f in word_features(w))
                if len(w) <= MEMO_CHARS:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[w] = got
            if got:
                values.append(got)
        z = sum(a * b for a, b in zip(self.logistic, [*_summary(values), 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(doc_id: Column) -> Column:
    """The remainder that says which rows are held out (0)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS):
    """(character model, feature hashes, weights, logistic weights), or None without labelled rows."""
    model = log_model(count_trigrams(docs, text))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    # At most train_rows ids: the bound of the broadcast.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def features(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            ids, ys = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = doc_features(restorer, t)
                ids += got
                ys += [y] * len(got)
            if ids:
                u, inverse = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
                n = np.bincount(inverse)
                pos = np.bincount(inverse, weights=np.array(ys, dtype=float)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64)), pa.array(pos)], names=["f", "n", "pos"])

    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    if not total["n"] or not total["pos"] or total["pos"] == total["n"]:
        return None
    base = total["pos"] / total["n"]
    counts = rows.mapInArrow(features, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # Odds of the label over twice those of the corpus, whatever its base rate.
    lift = F.col("pos") * (total["n"] - total["pos"]) > 2 * total["pos"] * (F.col("n") - F.col("pos"))
    strong = counts.where((F.col("n") >= LEAST_DOCS) & lift).toPandas()
    hashes, n, pos = (strong[c].to_numpy(dtype=np.int64) for c in ("f", "n", "pos"))
    weights = strength(n, pos, base)
    without = {k: strength(np.maximum(n - 1, 0), np.maximum(pos - k, 0), base) for k in (0, 1)}
    table = sc.broadcast((hashes, without[0], without[1]))

    def summaries(batches):
        restorer = Restorer(shared.value)
        f, w0, w1 = table.value
        of = {0: dict(zip(f.tolist(), w0.tolist())), 1: dict(zip(f.tolist(), w1.tolist()))}
        for batch in batches:
            xs, ys = [], batch.column(1).to_pylist()
            for t, y in zip(batch.column(0).to_pylist(), ys):
                xs.append(_summary(word_strengths(restorer, t, of[int(bool(y))])))
            yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in xs], pa.float64()) for k in range(4)], pa.array(ys, pa.int32())], names=["a", "b", "c", "d", "y"])

    seen = rows.mapInArrow(summaries, "a double, b double, c double, d double, y int").toPandas()  # at most train_rows
    logistic = fit_logistic(seen[["a", "b", "c", "d"]].to_numpy(), (seen["y"].to_numpy() > 0).astype(float))
    return model, hashes, weights, logistic


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1."""
    fitted = fit(docs, labels, doc_id, text, label, train_rows)
    if fitted is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = shared.__dict__.get("_scorer") or shared.__dict__.setdefault("_scorer", Scorer(*shared.value))
        return pa.array([scorer.score(t) for t in texts.to_pylist()], type=pa.float64())

    return docs.withColumn("toxicity", score(F.col(text)))


def restore(docs: DataFrame, text: str = "text", out: str = "restored") -> DataFrame:
    """``docs`` with the restored text; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(log_model(count_trigrams(docs, text)))

    @F.arrow_udf("string")
    def restored(texts: pa.Array) -> pa.Array:
        restorer = Restorer(shared.value)
        return pa.array([None if t is None else restorer.text(t) for t in texts.to_pylist()], type=pa.string())

    return docs.withColumn(out, restored(F.col(text)))
