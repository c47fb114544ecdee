"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with the path
of open tags (names, class and id words) above each. A bidirectional LSTM in numpy reads, for each
block, hashed vectors of its path and its words and a few figures, and labels it as main text or
not with the whole document as context. Weights come from ``train_html.py`` (``html_lstm.npz``).

Scripts, styles, comments of the markup and form controls never become blocks. Character references
are decoded, white space inside a block becomes one blank, blocks are trimmed, and the kept ones are joined
in page order by two newlines. The scanner reads a page once, whatever stands in it, and the labeller reads all words
of all blocks and paths; pages of any length and depth are read whole, with the whole page as context.

Null or empty pages and such without text give the empty string; text without any tag is one block. An unclosed script, style,
text area or comment hides the rest of a page, any other unclosed element hides nothing. A probability of just one half
keeps a block. An empty table gives an empty result; repeated rows and extra columns stay, but for one
named like the result.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS = os.path.join(os.path.dirname(__file__), "html_lstm.npz")
PATH_DIM, WORD_DIM, FIGURES = 96, 48, 10
INPUT = PATH_DIM + WORD_DIM + FIGURES
HIDDEN = 24
#: Blocks of a page that are turned into numbers at a time, and blocks of all pages of a group that are labelled in step.
WINDOW, GROUP = 512, 32_768

#: Tags that end a block of text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Tags without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is plain text but none of the page; unclosed ones run to the end.
RAW_TAGS = frozenset("script style textarea".split())
#: Elements whose content is no text of the page where they are closed.
HIDDEN_TAGS = frozenset("noscript template select button svg iframe object canvas title".split())
#: A tag of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_HIDDEN = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in HIDDEN_TAGS}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_EDGE = ".,:;!?()"


class Element:
    """An open element: the words by which paths know it (its tag, then class, id and role words), those of the innermost
    four words of the path down to it, and the hashed sum of all words of that path."""

    __slots__ = ("up", "tag", "names", "inner", "total")

    def __init__(self, up: Element | None, tag: str, names: tuple[str, ...]):
        self.up, self.tag, self.names = up, tag, names
        self.inner = ((up.inner if up else ()) + names)[-4:]
        self.total = _path_vector(names) if up is None else up.total + _path_vector(names)


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The words of the whole path, outermost first."""
        parts, e = [], self.element
        while e is not None:
            parts.append(e.names)
            e = e.up
        return tuple(w for names in reversed(parts) for w in names)


@lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        words += [f"{m[1].lower()[0]}:{w.lower()}" for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return tuple(words)


@lru_cache(maxsize=100_000)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h & 0x10000 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(names: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIM, dtype=np.float32)
    for w in names:
        slot, sign = _slot(w, PATH_DIM)
        out[slot] += sign
    return out


class Markup:
    """The markup of a page in one forward pass. An unclosed comment runs to the end. A quote hides ``>`` until it is closed;
    where that leaves a tag open to the end of the page, its quotes are stray, and from there on quotes count as
    other characters. Without any ``>`` to come the rest is text."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.pairs: dict[str, dict[int, int]] = {}

    def _tag_end(self, at: int) -> int:
        pos = at
        while self.quoted:
            stop = _STOP.search(self.page, pos)
            if stop and stop[0] == ">":
                return stop.end()
            pos = self.page.find(stop[0], stop.end()) + 1 if stop else 0
            if not pos:
                self.quoted = False
        return self.page.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, tag, attributes) of the next piece; tag is empty for comments and declarations."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4) + 3
                return start, end if end > 2 else len(page), False, "", ""
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start) + 1
                return (start, end, False, "", "") if end else None
            if m := _NAME.match(page, start):
                end = self._tag_end(m.end())
                return (start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]) if end else None
        return None

    def hidden_end(self, tag: str, start: int) -> int | None:
        """Where the hidden element that starts here ends; None if it is not closed. All elements of a tag are paired at once."""
        if tag not in self.pairs:
            found, opened = self.pairs.setdefault(tag, {}), []
            for m in _HIDDEN[tag].finditer(self.page):
                if not m[1]:
                    opened.append(m.start())
                elif opened:
                    found[opened.pop()] = m.end()
        close = self.pairs[tag].get(start)
        return None if close is None else self.page.find(">", close) + 1 or len(self.page)


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    top, inside, depth, open_tags = Element(None, "", ("body",)), None, 0, Counter()
    parts: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block(inside or top, text, min(linked, len(text))))
        linked = 0

    markup, at = Markup(page), 0
    while True:
        found = markup.next(at)
        text = page[at : found[0]] if found else page[at:]
        if text:
            parts.append(text)
            if link:
                linked += len(text)
        if not found:
            break
        start, at, closing, tag, attributes = found
        if tag in RAW_TAGS and not closing:
            if not attributes.rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag in HIDDEN_TAGS and not closing:
            if not attributes.rstrip().endswith("/"):
                at = max(at, markup.hidden_end(tag, start) or at)
            if tag in BLOCK_TAGS:
                flush()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag not in BLOCK_TAGS:
            continue
        elif closing:
            flush()
            while open_tags[tag]:
                open_tags[inside.tag] -= 1
                gone, inside = inside, inside.up
                if gone.tag == tag:
                    break
            link = 0
        else:
            flush()
            while inside and (inside.tag == "p" or inside.tag in CLOSES.get(tag, ())):
                open_tags[inside.tag] -= 1
                inside = inside.up
            if tag not in VOID_TAGS:
                inside = Element(inside, tag, _names(tag, attributes))
                open_tags[tag] += 1
    flush()
    return out


def features(blocks: list[Block], first: int = 0, count: int | None = None) -> np.ndarray:
    """One row of INPUT numbers for each block; ``first`` is the place of the first one among the ``count`` blocks of its page."""
    x = np.zeros((len(blocks), INPUT), dtype=np.float32)
    n = len(blocks) if count is None else count
    for i, b in enumerate(blocks):
        x[i, :PATH_DIM] = 0.7 * b.element.total + 0.3 * _path_vector(b.element.inner)
        words = b.text.lower().split()
        weight = 1 / (2 + len(words)) ** 0.5
        for w, k in Counter(words).items():
            slot, sign = _slot(w.strip(_EDGE), WORD_DIM)
            x[i, PATH_DIM + slot] += sign * k * weight
        size = len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (
            min(size, 4000) ** 0.5 / 20, 1.0 if size < 25 else 0.0, b.linked / size, sum(map(b.text.count, ".,;")) * 8 / size, sum(map(b.text.count, "0123456789")) * 4 / size,
            1.0 if b.text[-1:] in ".!?:" else 0.0, (first + i) / n, (n - first - i) / n, 1.0 if b.element.inner[-1] in ("h1", "h2", "h3", "h4") else 0.0, 1.0)
    return np.clip(x, -4, 4)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_direction(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hidden states of one direction over (pages, blocks, INPUT), and the state to go on from."""
    pages, steps, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), dtype=np.float32), np.zeros((pages, HIDDEN), dtype=np.float32))
    out = np.zeros((pages, steps, HIDDEN), dtype=np.float32)
    xw = x @ w + b
    for t in range(steps):
        z = xw[:, t] + h @ u
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        c = f * c + i * np.tanh(z[:, 3 * HIDDEN :])
        h = o * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


def reversed_within(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order, the padding still behind them."""
    at = np.arange(x.shape[1])[None, :]
    back = np.where(at < sizes[:, None], sizes[:, None] - 1 - at, at)
    return np.take_along_axis(x, back[:, :, None], axis=1)


def label(model: dict[str, np.ndarray], sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for each block of each sequence."""
    sizes = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), sizes.max(), INPUT), dtype=np.float32)
    for k, s in enumerate(sequences):
        x[k, : len(s)] = s
    ahead, _ = run_direction(x, model["w0"], model["u0"], model["b0"])
    back, _ = run_direction(reversed_within(x, sizes), model["w1"], model["u1"], model["b1"])
    p = sigmoid(np.concatenate([ahead, reversed_within(back, sizes), x], axis=2) @ model["v"] + model["c"])
    return [p[k, : sizes[k]] for k in range(len(sequences))]


def label_long(model: dict[str, np.ndarray], blocks: list[Block]) -> np.ndarray:
    """The same for one long page: both directions go window by window and carry their state on, so the whole page is context
    and only a number a block is held."""
    n, v = len(blocks), model["v"]
    z = np.full(n, model["c"][0], dtype=np.float32)
    state = None
    starts = range(0, n, WINDOW)
    for a in starts:
        x = features(blocks[a : a + WINDOW], a, n)
        h, state = run_direction(x[None], model["w0"], model["u0"], model["b0"], state)
        z[a : a + WINDOW] += h[0] @ v[:HIDDEN] + x @ v[2 * HIDDEN :]
    state = None
    for a in reversed(starts):
        x = features(blocks[a : a + WINDOW], a, n)[::-1]
        h, state = run_direction(x[None], model["w1"], model["u1"], model["b1"], state)
        z[a : a + WINDOW] += h[0][::-1] @ v[HIDDEN : 2 * HIDDEN]
    return sigmoid(z)


class Labeller:
    def __init__(self, path: str = WEIGHTS):
        with np.load(path) as f:
            self.model = {k: f[k].astype(np.float32) for k in f.files}

    def main_texts(self, pages: list[str | None]) -> list[str]:
        blocks = [leaf_blocks(p) for p in pages]
        kept: list[np.ndarray] = [np.zeros(0)] * len(blocks)
        short = sorted((k for k, bs in enumerate(blocks) if 0 < len(bs) <= WINDOW), key=lambda k: len(blocks[k]))
        while short:
            size = max(1, GROUP // len(blocks[short[-1]]))
            group, short = short[-size:], short[:-size]
            for k, p in zip(group, label(self.model, [features(blocks[k]) for k in group])):
                kept[k] = p >= 0.5
        for k, bs in enumerate(blocks):
            if len(bs) > WINDOW:
                kept[k] = label_long(self.model, bs) >= 0.5
        return ["\n\n".join(b.text for b, keep in zip(bs, ks) if keep) for bs, ks in zip(blocks, kept)]


_LABELLER: list[Labeller] = []


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    if not _LABELLER:
        _LABELLER.append(Labeller())
    texts: list[str] = []
    for k in range(0, len(pages), 128):
        texts += _LABELLER[0].main_texts(pages.slice(k, 128).to_pylist())
    return pa.array(texts, type=pa.string())


def extract_main_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""
    return pages.withColumn(out, _main_text(F.col(page)))
