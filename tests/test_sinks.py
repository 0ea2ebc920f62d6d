"""Results in several formats under one commit."""

import pytest

from flowloom.sources.sinks import ResultSink

SCHEMA = "window_id bigint, name string"


def rows(spark, low, high):
    return spark.createDataFrame([(k, None if k % 3 == 0 else f"a,\"{k}\"") for k in range(low, high)], SCHEMA)


def held(sink, name="json"):
    return sorted((r["window_id"], r["name"], r["batch"]) for r in sink.read(name, SCHEMA).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path))
    assert sink.read("csv", SCHEMA).collect() == []
    sink.process(rows(spark, 0, 5), 0)
    sink.process(rows(spark, 5, 9), 1)
    once = held(sink)
    assert [k for k, *_ in once] == list(range(9)) and held(sink, "csv") == once
    sink.process(rows(spark, 100, 200), 1)  # other rows under a committed id
    assert held(sink) == once and held(sink, "csv") == once
    assert sorted((r["n_rows"], r["batch"]) for r in sink.read("report", "n_rows bigint").collect()) == [(4, 1), (5, 0)]


def test_a_batch_that_fails_half_way_is_not_seen_and_is_written_again(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path), report=lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.process(rows(spark, 0, 5), 0)
    assert held(ResultSink(spark, str(tmp_path))) == []
    sink = ResultSink(spark, str(tmp_path))
    sink.process(rows(spark, 0, 3), 0)
    assert [k for k, *_ in held(sink)] == [0, 1, 2] and held(sink, "csv") == held(sink)
