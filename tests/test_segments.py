"""Cuts by rank against Python's sort; rows that no cut falls on are neither moved nor written."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import ordered, sampling, splits

TIE = ["a", "b"]


@pytest.fixture
def written(monkeypatch):
    """Rows of the working tables that the ranks write."""
    rows, write = [], ordered.materialize

    def counting(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ordered, "materialize", counting)
    return rows


def flows(spark, n=6000):
    rnd = random.Random(n)
    rows = [
        (i, rnd.choice([None, 1.5, float("nan")]), rnd.choice([None, "x", "x", "y", "z" if i % 500 == 0 else "y"]), rnd.choice([None, *range(300)]))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "a bigint, b double, key string, t bigint").repartition(5)


def ranked(spark, df, order):
    """Rows of each key, in order, by one sort in Spark."""
    out = {}
    for r in df.where("key IS NOT NULL").orderBy("key", *order).collect():
        out.setdefault(r.key, []).append(r.a)
    return out


def test_halves_are_those_of_the_sorted_hashes(spark, written):
    rows, df = flows(spark)
    got = {r.a: r.part for r in sampling.stratified_halves(df, "key", TIE, 0.4, seed=3).collect()}
    want = {}
    for ids in ranked(spark, df, [F.xxhash64(*TIE, F.lit(3)), *TIE]).values():
        want |= {a: "fit" if i < max(1, round(len(ids) * 0.6)) else "check" for i, a in enumerate(ids)}
    assert got == want
    assert sum(written) < len(rows) / 4


def test_mask_is_the_first_share_of_the_sorted_hashes(spark, written):
    rows, df = flows(spark)
    got = {r.a: r.masked for r in sampling.edge_mask(df, 0.15, ["key"], TIE).collect()}
    want = {}
    for ids in ranked(spark, df, [F.xxhash64(*TIE, F.lit(0)), *TIE]).values():
        want |= {a: i < int(len(ids) * 0.15) for i, a in enumerate(ids)}
    assert got == want
    assert sum(written) < len(rows) / 4


@pytest.mark.parametrize("rate", [0.0, 1.0])
def test_a_mask_of_nothing_and_of_everything(spark, rate):
    _, df = flows(spark, 50)
    assert {r.masked for r in sampling.edge_mask(df, rate, ["key"], TIE).collect()} == {rate == 1.0}


def test_files_are_cut_at_the_ranks_of_the_sorted_times(spark, written):
    rows, df = flows(spark)
    cut = splits.split_per_file(df, splits.SplitOptions(), [F.col("t"), *[F.col(c) for c in TIE]], "key")
    got = {r.a: r.split for r in cut.collect()}
    want = {}
    for ids in ranked(spark, df, ["t", *TIE]).values():
        n = len(ids)
        want |= {a: "train" if i < int(n * 0.7) else "val" if i < int(n * (0.7 + 0.15)) else "test" for i, a in enumerate(ids)}
    assert got == want
    assert sum(written) < len(rows) / 4


def test_equal_rows_on_a_cut_are_counted(spark):
    df = spark.createDataFrame([(7, 1.0, "x", None)] * 20 + [(7, 1.0, "y", 3)] * 3 + [(7, 1.0, None, 3)], "a bigint, b double, key string, t bigint")
    halves = sampling.stratified_halves(df, "key", TIE, 0.4).groupBy("key", "part").count().collect()
    assert {(r.key, r.part): r["count"] for r in halves} == {("x", "fit"): 12, ("x", "check"): 8, ("y", "fit"): 2, ("y", "check"): 1}
    cut = splits.split_per_file(df, splits.SplitOptions(), [F.col("t"), *[F.col(c) for c in TIE]], "key").groupBy("key", "split").count()
    assert {(r.key, r.split): r["count"] for r in cut.collect()} == {
        ("x", "train"): 14, ("x", "val"): 3, ("x", "test"): 3, ("y", "train"): 2, ("y", "test"): 1}


def test_an_empty_table_has_no_halves(spark):
    df = spark.createDataFrame([], "a bigint, b double, key string, t bigint")
    assert sampling.stratified_halves(df, "key", TIE, 0.4).collect() == []


@pytest.mark.parametrize("query", ["k10_stratified_halves", "k13_edge_mask", "t09_per_file_split", "a39_clip_outliers", "g10_class_offsets"])
def test_queries_do_not_write_their_rows_in_order(spark, tmp_path, monkeypatch, query):
    """The range partitions of all flows are gone: what is ranked is a small share of them."""
    from flowloom.catalog import load
    from flowloom.catalog import tables

    rnd = random.Random(1)
    spark.createDataFrame(
        [(i // 4, rnd.randrange(300), rnd.randrange(90), i % 4 + 1, float(rnd.randrange(1, 51)), rnd.random() * 900, 0.05, 0.02, "A", "O",
          f"199{rnd.randrange(2, 5)}-0{rnd.randrange(1, 10)}-{rnd.randrange(10, 28)}") for i in range(8000)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, d string",
    ).withColumn("l_shipdate", F.col("d").cast("timestamp")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 70).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows, rank = [], ordered.row_ranks

    def counting(df, *args):
        rows.append(df.count())
        return rank(df, *args)

    for module in (ordered, sampling, splits):
        monkeypatch.setattr(module, "row_ranks", counting)
    n = tables.clean(spark, str(tmp_path)).count()
    load()[0][query](spark, str(tmp_path)).collect()
    assert n > 7000 and sum(rows) < n / 3
