"""The lookup join spreads hot keys and keeps every row."""

import pytest
from pyspark.sql import functions as F

from tarmac.plans import lookup as module
from tarmac.plans.lookup import lookup


@pytest.fixture(params=[(1e-4, 100_000), (1e-3, 1), (0.1, 1)], ids=["none hot", "all hot", "some hot"])
def limits(request, monkeypatch):
    monkeypatch.setattr(module, "HOT_SHARE", request.param[0])
    monkeypatch.setattr(module, "LEAST_ROWS", request.param[1])


def feed(spark):
    """2000 rows: a third of key 0, a fifth of key 1, some without a key, the rest spread over unknown and known keys."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE id % 40 END")
    return spark.range(2000).select("id", key.alias("key"))


def test_same_as_a_left_join(spark, limits):
    rows = feed(spark)
    base = spark.range(30).selectExpr("id AS key", "concat('v', id) AS value")
    expected = rows.join(base, "key", "left").select("id", "key", "value").collect()
    assert sorted(lookup(rows, base, ["key"], "id").select("id", "key", "value").collect(), key=str) == sorted(expected, key=str)
    assert sorted(
        lookup(rows, base, ["key"], "id", counted=rows.select("key")).select("id", "key", "value").collect(), key=str
    ) == sorted(expected, key=str)


def test_two_keys(spark, limits):
    rows = feed(spark).withColumn("other", F.col("key") % 2)
    base = spark.range(30).selectExpr("id AS key", "id % 2 AS other", "id * 10 AS value")
    expected = rows.join(base, ["key", "other"], "left").select("id", "value").collect()
    got = lookup(rows, base, ["key", "other"], "id").select("id", "value").collect()
    assert sorted(got) == sorted(expected, key=lambda r: r.id)


def test_a_hot_key_takes_several_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST_ROWS", 50)
    df = lookup(feed(spark), spark.range(30).withColumnRenamed("id", "key"), ["key"], "id")
    joined = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in joined and df.count() == 2000
