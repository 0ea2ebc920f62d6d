"""Ranks of a total order against Python's sort."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import ordered


@pytest.mark.parametrize("n,parts", [(2000, 7), (2000, 1), (3, 40)])
def test_positions_are_those_of_the_sorted_rows(spark, n, parts):
    rnd = random.Random(n + parts)
    rows = [(k, rnd.choice([None, *range(5)]), rnd.random()) for k in range(n)]
    df = spark.createDataFrame(rows, "id int, t int, x double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r["id"]: r["rank"] for r in ordered.row_ranks(df, [], [F.col("t"), F.col("id")]).collect()}
        newest = {r["id"]: r["rank"] for r in ordered.row_ranks(df, [], [F.desc("t"), F.col("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known = lambda t: (t is not None, t or 0)
    assert found == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (known(r[1]), r[0])))}
    assert newest == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (not known(r[1])[0], -known(r[1])[1], r[0])))}


def test_one_exchange_before_the_write(spark, monkeypatch):
    plans = []
    written = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or written(df, name))
    df = spark.range(100).withColumn("t", F.col("id") % 7)
    ordered.row_ranks(df, [], [F.col("t"), F.col("id")]).collect()
    assert plans[0].count("Exchange") == 1 and "Window" not in plans[0]


def test_an_empty_table_has_no_positions(spark):
    assert ordered.row_ranks(spark.createDataFrame([], "t int"), [], [F.col("t")]).collect() == []
