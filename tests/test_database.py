"""The database reader against a real database: Derby, which comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def url():
    return f"jdbc:derby:memory:content{uuid.uuid4().hex};create=true"


@pytest.fixture(scope="module")
def stored(spark, url):
    out = {}
    for name in ("crawl_jobs", "content_hashes", "system_metrics"):
        out[name] = getattr(catalog.S, name)(spark, SF).select([f.name for f in tables.schema(name)])
        texts = ", ".join(f"{f.name} VARCHAR(200)" for f in tables.schema(name) if f.dataType.simpleString() == "string")
        out[name].write.format("jdbc").options(url=url, dbtable=name, createTableColumnTypes=texts).mode("overwrite").save()
    return out


@pytest.mark.parametrize(("name", "low", "high"), [("crawl_jobs", "0", "1000"), ("content_hashes", "0", "200"), ("system_metrics", "100", "300")])
def test_rows_come_back_in_ranges(spark, url, stored, name, low, high):
    """Whatever the bounds, no row is left out; each range is a task of its own."""
    got = tables.read_database(spark, name, url, low, high, 4)
    assert got.rdd.getNumPartitions() == 4
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in tables.schema(name)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, stored[name].collect()), key=str)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_filters_and_columns_reach_the_database(spark, url, stored):
    got = tables.read_database(spark, "crawl_jobs", url, "0", "1000", 4).where("status = 'failed' and id > 10").select("id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,failed)" in plan and "GreaterThan(id,10)" in plan
    assert "started_at" not in plan
    assert {r.id for r in got.collect()} == {r.id for r in stored["crawl_jobs"].where("status = 'failed' and id > 10").collect()}


def test_analytics_over_the_database(spark, url, stored):
    """A query of the catalog's operators runs over tables that come from the database."""
    jobs = tables.read_database(spark, "crawl_jobs", url, "0", "1000", 4)
    ago = catalog.now() - F.expr("interval 9 days")
    from quarry.operators import analytics

    assert analytics.crawl_efficiency_alert(jobs, ago).collect() == analytics.crawl_efficiency_alert(stored["crawl_jobs"], ago).collect()
