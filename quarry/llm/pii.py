"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
URL schemes and the cues of identifiers. From each anchor a deterministic parser expands to the
boundaries of the value and validates it. The four base kinds come out as the leftmost
non-overlapping matches of their patterns, because each parser starts at the first place not yet
taken at which its pattern can match:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from the at-sign to both sides
* ip, four numbers of at most 255, from the first digit
* card, 12 to 19 digits with single blanks or hyphens between, Luhn sum 0, from the first digit
* phone, ``+`` and 9 to 15 digits, from the plus sign

Added kinds: url (a scheme and what follows up to white space, quote or bracket), iban (cue
``iban``, checksum mod 97), key (cue ``AKIA`` and 16 capitals or digits), secret (cue
``password``, ``passwd``, ``secret``, ``token``, ``api_key``, then ``=`` or ``:`` and a value of 8
or more characters with a digit; cues inside such a value are part of it).

Null or empty texts have no spans. Spans count code points and end exclusively; they are sorted by
start, then (ties) by kind in the order above. No parser reads a stretch of text more than a few times, so very long texts
take time in proportion. An empty table gives an empty result; repeated rows and extra columns stay as they are, but for one named like the result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "key", "secret")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_DIGITS = re.compile(r"[0-9]+").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_URL = re.compile(r"[^\s\"'<>()\[\]{}]+").match
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])").match
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])").match
_SECRET = re.compile(r"\s?[=:]\s?[\"']?([^\s\"',;]{8,})").match

#: What the automaton looks for, in any case but for the access key.
_CUES = {"at": ["@"], "plus": ["+"], "digit": list("0123456789"), "url": ["http://", "https://", "ftp://"], "iban": ["iban"], "key": ["akia"], "secret": ["password", "passwd", "secret", "token", "api_key", "apikey"]}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for what, words in _CUES.items():
        for w in words:
            out.add_word(w, (what, len(w)))
    out.make_automaton()
    return out


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _folded(text: str) -> str:
    """Lower case with every character in its place (a few grow when lowered)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end)."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    email_end = ip_from = card_from = url_end = secret_end = 0
    for last, (what, size) in _ANCHORS.iter(_folded(text)):
        at = last - size + 1
        if what == "digit":
            if at >= ip_from:
                m = _IP(text, at)
                if m:
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append(("ip", at, ip_from))
                else:
                    ip_from = _DIGITS(text, at).end()
            if at >= card_from:
                m = _CARD(text, at)
                if m:
                    card_from = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append(("card", at, card_from))
                else:
                    card_from = at + 1
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN(text, at + 1)):
                email_end = m.end()
                out.append(("email", start, email_end))
        elif what == "plus":
            m = _PHONE(text, at)
            if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at, m.end()))
        elif what == "url":
            if at >= url_end and (m := _URL(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?"))
                if end > last + 1:
                    out.append(("url", at, end))
                    url_end = end
        elif what == "iban":
            if m := _IBAN(text, last + 1):
                plain = m[1].replace(" ", "")
                number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
                if 15 <= len(plain) <= 34 and int(number) % 97 == 1:
                    out.append(("iban", m.start(1), m.end(1)))
        elif what == "key":
            if text[at : at + 4] == "AKIA" and not (at and text[at - 1].isalnum()) and (m := _KEY(text, last + 1)):
                out.append(("key", at, m.end()))
        elif at >= secret_end and (m := _SECRET(text, last + 1)):
            # Cues inside a value name no value of their own, whether this one counts or not.
            secret_end = m.end(1)
            if any(c.isdigit() for c in m[1]):
                out.append(("secret", m.start(1), m.end(1)))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return list(dict.fromkeys(out))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts.to_pylist()], type=kind)


def _without(text: str | None) -> str | None:
    found = find(text)
    if not found:
        return text
    parts, at = [], 0
    for kind, start, end in found:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([_without(t) for t in texts.to_pylist()], type=pa.string())


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with a column of spans, ``array<struct<kind,start,end>>``; never null."""
    return df.withColumn(out, _spans(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` whose text has ``[KIND]`` in the place of each span; overlapping spans become the first
    one's. Null texts stay null."""
    return df.withColumn(text, _redacted(F.col(text)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` joined by commas, for the given kinds."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
