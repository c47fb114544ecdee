"""Languages of texts that the model has not seen, whole and short."""

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(catalog.S.articles(spark, SF).where("id % 5 <> 0"))


@pytest.mark.parametrize(("size", "least"), [(1000, 0.97), (80, 0.95), (25, 0.8)])
def test_held_out_accuracy(spark, model, size, least):
    a = catalog.S.articles(spark, SF).where("id % 5 = 0 and length(content) > 60").withColumn("content", F.substring("content", 1, size))
    got = {r.language: (r.n, r.part) for r in language.detect(a, model).groupBy("language").agg(F.count("*").alias("n"), F.avg((F.col("detected") == F.col("language")).cast("int")).alias("part")).collect()}
    assert len(got) == 4
    for name, (n, part) in got.items():
        assert part >= least, (name, n, part)


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "the house of the people and the law of the land")], "id long, content string")
    assert [r.detected for r in language.detect(df, model).orderBy("id").collect()][:4] == ["en"] * 4
    assert language.detect(df.limit(0), model).collect() == [] and language.fit(df.withColumn("language", F.lit(None).cast("string"))) is None
    assert {r.detected for r in language.detect(df, None, default="fr").collect()} == {"fr"}
    one = language.fit(spark.createDataFrame([(1, "ab", "xx")], "id long, content string, language string"))
    assert one.best("anything") == "xx"


def test_sample_is_bounded(spark):
    few = language.fit(catalog.S.articles(spark, SF), sample=40)
    assert len(few.known) < 20_000 and few.languages == sorted(few.languages)
