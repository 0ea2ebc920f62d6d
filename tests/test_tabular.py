"""Edges with the features of both ends, whichever way they are joined."""

import random

import pytest

from flowloom.operators import rules


@pytest.mark.parametrize("small,heavy", [(1 << 30, 100), (0, 100), (0, 1), (0, 10**9)])
def test_rows_are_the_same_however_hosts_are_joined(spark, monkeypatch, small, heavy):
    monkeypatch.setattr(rules, "SMALL", small)
    monkeypatch.setattr(rules, "HEAVY", heavy)
    rnd = random.Random(4)
    hosts = [0, *range(2, 40)]
    edges = [(k, rnd.randrange(3), rnd.choice([7, 7, 7, *hosts]), rnd.choice([0, 0, *hosts]), k % 4, float(k)) for k in range(900)]
    nodes = [(w, h, w + h / 100, float(h)) for w in range(3) for h in hosts if h != 39]
    frame = spark.createDataFrame(edges, "id int, window_id int, src bigint, dst bigint, y int, size double").repartition(6)
    known = spark.createDataFrame(nodes, "window_id int, host bigint, a double, b double")
    found = rules.tabular_rows(frame, known, ["size"], ["a", "b"], ids=["id"])
    assert found.columns == ["window_id", "id", "src", "dst", "y", "size", "src_a", "src_b", "dst_a", "dst_b"]
    value = {(w, h): (a, b) for w, h, a, b in nodes}
    want = [(w, k, s, d, y, x, *value[w, s], *value[w, d]) for k, w, s, d, y, x in edges if 39 not in (s, d)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_heavy_host_stays_spread(spark, monkeypatch):
    """Half of a window's edges go to one host; no task of the join gets them all."""
    monkeypatch.setattr(rules, "SMALL", 0)
    monkeypatch.setattr(rules, "HEAVY", 1000)
    edges = spark.range(40_000, numPartitions=8).selectExpr(
        "cast(id as int) id", "0 window_id", "id % 5000 + 10 src", "if(id % 2 = 0, 1, id % 4000 + 10) dst", "0 y", "1.0d size"
    )
    nodes = spark.range(6000).selectExpr("0 window_id", "id host", "cast(id as double) a")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sizes = rules.tabular_rows(edges, nodes, ["size"], ["a"], ids=["id"]).groupBy(
            rules.F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert sizes.sum() == 40_000 and sizes.max() < 2 * sizes.median()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
