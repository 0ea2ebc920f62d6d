"""Tables that the catalog writes once."""

from pyspark.sql import functions as F

from flowloom.catalog.tables import staged


def test_a_staged_table_is_written_by_the_tasks_that_made_it(spark, tmp_path):
    """Rows are not moved once more, into as many parts as there are cores whatever their number."""
    parts = 2 * spark.sparkContext.defaultParallelism + 1
    made = staged(spark, str(tmp_path), "numbers", lambda spark, sf: spark.range(0, 1000, 1, parts))
    assert made.select(F.input_file_name()).distinct().count() == parts
    assert made.agg(F.sum("id")).first()[0] == 499_500


def test_scored_flows_are_a_view_of_the_flow_table(spark, monkeypatch):
    """Six probabilities of a flow, with no second copy of the wide rows on disk."""
    from flowloom.catalog import tables

    written = []
    monkeypatch.setattr(tables, "staged", lambda spark, sf, name, build: written.append(name) or build(spark, sf))
    row = "5 AS l_orderkey, 7 AS l_partkey, 3 AS l_suppkey, 2 AS l_linenumber, 40D AS l_quantity, 10D AS l_extendedprice"
    items = spark.sql(f"SELECT {row}, 0D AS l_discount, 0D AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, timestamp'2024-01-01' AS l_shipdate")
    orders = spark.sql("SELECT 5 AS o_orderkey, 9 AS o_custkey")
    monkeypatch.setattr(tables, "table", lambda spark, sf, name: {"lineitem": items, "orders": orders}[name])
    found = tables.scored(spark, "no folder").collect()
    weights = [1 + (5 * (k + 3) + 2 * 7 + 7 * (2 * k + 1)) % 97 + (60 if k == 4 else 0) for k in range(6)]
    assert [r.y for r in found] == [4] and written == ["flows"]
    assert found[0].probs == [w / sum(weights) for w in weights]
