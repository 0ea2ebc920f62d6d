"""A sample of the registered queries against DuckDB at the smallest scale; verify.py runs all."""

import glob
import os

import duckdb
import pytest

from flowloom.catalog import load
from verify import normal

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = [
    "g00_suspicious_hosts", "g01_graph_edges", "x09_node_features", "w01_time_since_contact", "t03_episode_split", "a39_clip_outliers",
    "a25_class_ap", "a30_operating_points", "m04_rule_outcomes", "a08_host_table", "r02_closed_windows", "s01_load_flow_csv",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got, want = normal(QUERIES[name](spark, SF).toPandas()), normal(db.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
