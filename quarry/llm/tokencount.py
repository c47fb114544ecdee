"""Token counts of whole texts, as the ``tokenizers`` or ``sentencepiece`` library gives them.

Arrow functions encode in batches and return lengths only. For a byte-level BPE file the text is
split at safe boundaries first (``chunks.safe_chunks``: the pre-tokenizer always cuts there, and
no added token holds a blank), so that no call holds a long text whole; the distinct chunks of an
Arrow batch that the worker has not counted yet go to the library in batches of about equal bytes.
Other tokenizers look across blanks (a normalizer or model may join what stands on both sides), so there is no boundary
that is safe for all of them: whole texts go to the library, again balanced by bytes.

Null texts are empty: no bytes, no tokens; very long ones are counted whole. Repeated rows are counted each, an empty table
gives an empty result; extra columns stay, one of the name of a result is replaced. Texts that are equal have equal counts.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import safe_chunks

#: Bytes of text in one call of the library.
CALL_BYTES = 1 << 20
#: Chunks whose count a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 400_000, 48

_COUNTERS: dict[str, Counter] = {}


class Counter:
    def __init__(self, name: str, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        if name.endswith(".model"):
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.lengths = lambda texts: [len(x) for x in self.lib.encode(texts, num_threads=1)]
            self.split = False
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_str(raw.decode())
            self.lib.no_truncation()
            self.lib.no_padding()
            self.lengths = lambda texts: [len(x) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
            about = json.loads(raw)
            self.split = (
                (about.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
                and about["pre_tokenizer"].get("use_regex", True)
                and not about["pre_tokenizer"].get("add_prefix_space")
                and not about.get("normalizer")
                and all(" " not in t["content"] and not t.get("lstrip") and not t.get("rstrip") for t in about.get("added_tokens", []))
            )

    def balanced(self, texts: list[str]) -> list[int]:
        """Lengths of the texts, encoded in calls of about CALL_BYTES."""
        out: list[int] = []
        call: list[str] = []
        held = 0
        for t in texts:
            call.append(t)
            held += (len(t) if t.isascii() else len(t.encode())) + 32
            if held >= CALL_BYTES:
                out += self.lengths(call)
                call, held = [], 0
        return out + (self.lengths(call) if call else [])

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.split:
            return self.balanced([t or "" for t in texts])
        memo = self.memo
        cut = [safe_chunks(t) if t else [] for t in texts]
        if len(memo) > MEMO:
            memo.clear()
        new = [c for c in dict.fromkeys(c for cs in cut for c in cs) if c not in memo]
        memo.update(zip(new, self.balanced(new)))
        out = [sum(map(memo.__getitem__, cs)) for cs in cut]
        for c in new:
            if len(c) > MEMO_CHARS:
                del memo[c]
        return out


def _counter(name: str, raw: bytes) -> Counter:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(name, raw)
    return _COUNTERS[key]


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit)."""
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the size of the file
    name = os.path.basename(path)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(name, shared.value).count(texts.to_pylist()), type=pa.int64())

    out = df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", count(F.col(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
