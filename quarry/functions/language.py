"""Language of a text by a naive Bayes model over character trigrams.

The model is fitted on a bounded sample of rows whose language is known; what reaches the driver are its trigram counts. Weights are
whole thousandths of natural logarithms, so a score is the same in any order of addition.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on, at most, in the order of the MD5 of their id; characters read of a text.
SAMPLE_ROWS, READ = 2000, 1000


def opening(text: Column) -> Column:
    return F.lower(F.substring(F.coalesce(text, F.lit("")), 1, READ))


def grams(text: str) -> np.ndarray:
    """The trigrams of a text as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


class Model(NamedTuple):
    """Languages in alphabetical order, their score for a text without trigrams and for each unknown trigram, known trigrams and what each
    adds to that of an unknown one."""

    languages: list[str]
    prior: np.ndarray
    unknown: np.ndarray
    known: np.ndarray
    gain: np.ndarray

    def best(self, text: str) -> str:
        """The likeliest language; of equals the first in the alphabet."""
        g = grams(text)
        score = self.prior + self.unknown * len(g)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            score = score + self.gain[at[self.known[at] == g]].sum(0)
        return self.languages[int(score.argmax())]


def fit(rows: DataFrame, sample: int = SAMPLE_ROWS) -> Model | None:
    """rows: id, content, language. None without a row of known language."""
    some = rows.where("language is not null").orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample).select("language", opening(F.col("content")).alias("text"))

    def count(batches):
        for batch in batches:
            parts = [pd.DataFrame({"language": [], "gram": [], "n": [], "docs": []})]
            for language, text in batch.itertuples(index=False):
                g, n = np.unique(grams(text), return_counts=True)
                parts.append(pd.DataFrame({"language": language, "gram": np.append(g, -1), "n": np.append(n, 0), "docs": np.append(np.zeros(len(g)), 1)}))
            yield pd.concat(parts).astype({"gram": "int64", "n": "int64", "docs": "int64"})

    seen = some.mapInPandas(count, "language string, gram long, n long, docs long").groupBy("language", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    if not len(seen):
        return None
    languages = sorted(seen["language"].unique())
    docs = seen.groupby("language")["docs"].sum()
    found = seen[seen["gram"] >= 0]
    total, size = found.groupby("language")["n"].sum(), found["gram"].nunique()
    weight = lambda n, k: math.floor(1000 * math.log((n + 1) / (float(total.get(k, 0)) + size)))
    prior = np.array([math.floor(1000 * math.log(docs[k] / docs.sum())) for k in languages])
    unknown = np.array([weight(0, k) if size else 0 for k in languages])
    known, row = np.unique(found["gram"], return_inverse=True)
    gain = np.zeros((len(known), len(languages)), dtype=np.int64)
    for r, k, n in zip(row, found["language"], found["n"]):
        column = languages.index(k)
        gain[r, column] = weight(n, k) - unknown[column]
    return Model(languages, prior, unknown, known, gain)


def detect(rows: DataFrame, model: Model | None, text: str = "content", out: str = "detected", default: str = "en") -> DataFrame:
    """``rows`` with the language of the text's first READ characters in ``out``; the default for null and blank texts or without
    a model, which has some megabytes at most whatever the data."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    if model is None:
        return rows.withColumn(out, F.lit(default))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.best)

    return rows.withColumn(out, F.when(blank, F.lit(default)).otherwise(best(opening(F.col(text)))))
