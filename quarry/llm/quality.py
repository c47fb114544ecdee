"""Quality rules as a short-circuit cascade of native expressions.

A rule names the counts that it needs and says from them which documents to reject. ``plan_cascade``
measures on a sample how long each rule takes and how many rows it rejects, and orders the rules by
rejection per cost; ``apply_rules`` evaluates them in that order. A count is a column of its own,
computed once, for the first rule that needs it, and only where no earlier rule has rejected the row.
The order changes the time, never the verdict, and every row is judged.

Repeated windows are looked for in two steps: the 64-bit hashes of all 3-word windows of a text are made
distinct, and only a text that has one twice goes on to find which words such windows cover.

Null and empty texts have no words: zero counts, rejected as too short. A word is a run of
characters other than blank and ``\\t\\n\\x0b\\f\\r``. Very long texts are judged whole. Rules that tie in
rejection per cost keep the given order; an empty table gives an empty result. Repeated rows are judged
each; extra columns stay, except those that have the name of a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: A separator of words, as a regular expression.
SEPARATOR = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample from which cost and selectivity are estimated, and bytes of the longest text in it: what the
#: driver may be sent. ``take`` reads only as many partitions as it needs, so the estimate costs the same for any table.
SAMPLE_ROWS, SAMPLE_TEXT = 300, 1 << 18
#: How often the sample is read in one measurement, and measurements of a rule of which the least counts.
REPEATS, TRIALS = 4, 2


class Rule(NamedTuple):
    """Counts that a rule needs, and from them a condition that is true for a document to reject."""

    needs: tuple[str, ...]
    rejects: Callable[..., Column]


RULES: dict[str, Rule] = {
    "few_words": Rule(("n_words",), lambda n: n < 50),
    # More than a symbol for each ten words.
    "many_symbols": Rule(("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    # More than six in ten characters of words are the capitals A to Z.
    "shouted": Rule(("n_capitals", "word_chars"), lambda c, n: 10 * c > 6 * n),
    # A mean word of under 2 or over 20 characters.
    "odd_word_length": Rule(("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    # More than six in ten lines equal an earlier one.
    "repeated_lines": Rule(("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 6 * n),
    "repeated_words": Rule(("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
}
BASE_RULES = ("few_words", "repeated_words")
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Helper columns that a count is made from.
_FROM = {"n_words": "words", "word_chars": "words", "n_repeat_words": "words", "n_dup_lines": "lines", "n_lines": "lines"}


def _name(count: str) -> str:
    return f"__quality_{count}"


def _c(count: str) -> Column:
    return F.col(_name(count))


def _helper(kind: str, text: Column) -> Column:
    if kind == "words":
        return F.array_remove(F.split(text, SEPARATOR + "+"), "")
    # Lines that hold a word: a separator takes the blank lines behind it along.
    return F.array_remove(F.split(F.concat(F.lit("\n"), text, F.lit("\n")), rf"\n(?:{SEPARATOR}*\n)?"), "")


def _simple(count: str, text: Column) -> Column:
    if count == "n_words":
        return F.size(_c("words"))
    if count == "word_chars":
        return F.length(F.array_join(_c("words"), ""))
    if count == "n_symbols":
        return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    if count == "n_capitals":
        return F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    if count == "n_lines":
        return F.size(_c("lines"))
    return F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))


def _with_repeats(df: DataFrame, where: Column) -> DataFrame:
    """Words in 3-word windows that the text has twice or more."""
    w = _c("words")
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn(_name("windows"), F.when(where & (F.size(w) > 3), hashed))
    n = F.size(_c("windows"))
    df = df.withColumn(_name("some"), F.coalesce(F.size(F.array_distinct(_c("windows"))) < n, F.lit(False)))
    # Sorting puts equal windows side by side.
    df = df.withColumn(_name("sorted"), F.when(_c("some"), F.sort_array(F.arrays_zip(_c("windows").alias("h"), F.sequence(F.lit(0), n - 1).alias("i")))))
    h = _c("sorted")["h"]
    sides = F.arrays_zip(h.alias("h"), _c("sorted")["i"].alias("i"), F.concat(F.array(F.lit(None).cast("long")), h).alias("before"), F.slice(h, 2, F.size(h)).alias("after"))
    twice = F.filter(sides, lambda x: (x["h"] == x["before"]) | (x["h"] == x["after"]))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    found = F.when(_c("some"), F.size(F.array_distinct(covered))).otherwise(F.lit(0))
    return df.withColumn(_name("n_repeat_words"), found.cast("long")).drop(_name("windows"), _name("some"), _name("sorted"))


def with_counts(df: DataFrame, counts: Sequence[str], text: Column, where: Column | None = None) -> DataFrame:
    """``df`` with the columns of the given counts that it does not have yet; null where ``where`` is false."""
    todo = [c for c in counts if _name(c) not in df.columns]

    def only(value: Column) -> Column:
        return value if where is None else F.when(where, value)

    for kind in dict.fromkeys(_FROM[c] for c in todo if c in _FROM):
        if _name(kind) not in df.columns:
            df = df.withColumn(_name(kind), only(_helper(kind, text)))
    # A helper may have been made for fewer rows only if those that are left now are fewer still.
    plain = {_name(c): only(_simple(c, text)).cast("long") for c in todo if c != "n_repeat_words"}
    df = df.withColumns(plain) if plain else df
    return _with_repeats(df, F.lit(True) if where is None else where) if "n_repeat_words" in todo else df


def cascade(df: DataFrame, text: Column, rules: dict[str, Rule], order: Sequence[str]) -> DataFrame:
    """``df`` with ``__quality_verdict``, the first rule of the order that rejects a row. A verdict that is there already stands."""
    if _name("verdict") not in df.columns:
        df = df.withColumn(_name("verdict"), F.lit(None).cast("string"))
    for k, name in enumerate(order):
        rule = rules[name]
        # The first rule sees every row.
        df = with_counts(df, rule.needs, text, _c("verdict").isNull() if k else None)
        df = df.withColumn(_name("verdict"), F.coalesce(_c("verdict"), F.when(rule.rejects(*map(_c, rule.needs)), F.lit(name))))
    # A filter on the verdict must not be pushed below it: the optimizer would write all counts out once for the
    # filter and once for the column. It does not push what a generator makes.
    return df.withColumn(_name("verdict"), F.explode(F.array(_c("verdict"))))


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__quality_")])


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    return _without_helpers(_counted(df, text))


def _counted(df: DataFrame, text: str) -> DataFrame:
    out = with_counts(df, BASE_COUNTS, text_of(text))
    out = out.withColumns({c: _c(c) for c in BASE_COUNTS})
    few, repeated = (RULES[r].rejects(*map(_c, RULES[r].needs)) for r in BASE_RULES)
    return out.withColumn("base_failed", few | repeated)


def plan_cascade(df: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejected rows per second on a sample of ``sample_rows`` rows (a bounded, documented estimate; it decides
    only the order). A rule's seconds are those of a job over the repeated sample less those of a job without any
    rule, after a run that compiles it. An empty table keeps the given order."""
    rows = df.select(text_of(text).alias("t")).where(F.octet_length("t") <= SAMPLE_TEXT).take(sample_rows)
    if not rows:
        return list(rules)
    tables = Tables(df.sparkSession)
    sample = tables.keep(df.sparkSession.createDataFrame(rows, "t string").coalesce(1), "sample")
    many = sample.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(job: DataFrame) -> float:
        took = []
        for _ in range(TRIALS + 1):
            began = time.perf_counter()
            job.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    judged = sample
    for rule in rules.values():
        judged = with_counts(judged, rule.needs, F.col("t"))
    rejected = judged.agg(*[F.count_if(rule.rejects(*map(_c, rule.needs))).alias(name) for name, rule in rules.items()]).first()
    idle = seconds(many.select(F.octet_length("t")))
    score = {}
    for name, rule in rules.items():
        took = seconds(with_counts(many, rule.needs, F.col("t")).select(rule.rejects(*map(_c, rule.needs))))
        score[name] = (rejected[name] + 0.5) / len(rows) / max(took - idle, 1e-4)
    tables.drop(sample)
    return sorted(rules, key=lambda name: -score[name])


def apply_rules(df: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``rejected_by``, the first rule of the order that rejects a row, null if none does."""
    judged = cascade(df, text_of(text), rules, order or plan_cascade(df, text, rules))
    return _without_helpers(judged.withColumn("rejected_by", _c("verdict")))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts, ``base_failed`` and ``kept``. What the base decides is known from
    its counts; the cascade of the other rules uses the same counts and runs only for rows that pass it."""
    others = {k: v for k, v in RULES.items() if k not in BASE_RULES}
    order = plan_cascade(df, text, others)
    out = _counted(df, text).withColumn(_name("verdict"), F.when(F.col("base_failed"), F.lit("base")))
    out = cascade(out, text_of(text), others, order).withColumn("kept", _c("verdict").isNull())
    return _without_helpers(out)
