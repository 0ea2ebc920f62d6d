"""Streams against the same input as a batch."""

import pytest
from pyspark.sql import functions as F

from flowloom.streaming.state import host_history_stream, host_memory_stream
from flowloom.streaming.windows import WindowCloser, run_to_end

SCHEMA = "t bigint, src_ip string, dst_ip string, id int"


def rows(spark):
    return spark.range(600).select(
        (F.col("id") * 7).alias("t"), (F.col("id") % 5).cast("string").alias("src_ip"), F.lit("d").alias("dst_ip"), F.col("id").cast("int").alias("id")
    )


def test_windows_equal_batch_and_replay_changes_nothing(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        rows(spark).where(F.floor(F.col("id") / 200) == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    closer = WindowCloser(spark, root, SCHEMA, seconds=60, block=600)
    run_to_end(stream, closer, f"{root}/checkpoint")
    want = {r.w: r.n for r in rows(spark).groupBy(F.floor(F.col("t") / 60).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.window_id: r.n_flows for r in closer.results().collect()}
    assert got == want
    last = spark.read.parquet(src).where("id >= 400")
    closer.process(last, 2)  # the same batch id again
    assert {r.window_id: r.n_flows for r in closer.results().where("n_flows > 0").collect()}.keys() == want.keys()


def test_late_rows_are_kept_apart(spark, tmp_path):
    closer = WindowCloser(spark, str(tmp_path), SCHEMA, seconds=60, delay=0)
    closer.process(rows(spark).where("t < 300"), 0)
    closer.process(rows(spark).where("t >= 300 AND t < 900"), 1)
    closer.process(rows(spark).where("t < 60"), 2)
    assert closer.late().count() == rows(spark).where("t < 60").count()


def test_a_run_after_a_flush_loses_no_row(spark, tmp_path):
    """Rows for a window that a flush closed are late; results and late rows make up the input."""
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    flows = spark.range(110).select(
        F.col("id").alias("t"), F.lit("s").alias("src_ip"), F.lit("d").alias("dst_ip"), F.col("id").cast("int").alias("id")
    )
    closer = WindowCloser(spark, root, SCHEMA, seconds=60)
    for low, high in ((0, 90), (90, 110)):
        flows.where(f"t >= {low} AND t < {high}").coalesce(1).write.mode("append").parquet(src)
        run_to_end(spark.readStream.schema(SCHEMA).parquet(src), closer, f"{root}/checkpoint")
        closer.flush()  # nothing is left to close
    got = sorted((r.window_id, r.n_flows) for r in closer.results().where("n_flows > 0").collect())
    assert got == [(0, 60), (1, 30)] and closer.late().count() == 20


def test_staging_and_progress_stay_small(spark, tmp_path):
    closer = WindowCloser(spark, str(tmp_path), SCHEMA, seconds=60, block=60)
    for k in range(8):
        closer.process(rows(spark).where(f"t >= {k * 300} AND t < {(k + 1) * 300}"), k)
    folders = lambda name: [p for p in (tmp_path / name).iterdir() if p.is_dir()]
    assert len(folders("staging")) <= 2 and len(folders("progress")) <= 2
    assert closer.results().agg(F.sum("n_flows")).first()[0] >= rows(spark).where("t < 2340").count()


def seen_in_two_runs(spark, tmp_path, make, rows, cut):
    """Rows of a keyed stream that reads the windows up to ``cut``, stops, and reads the others."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ip string, window_end bigint, flows_now bigint"
    frame = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("window_end"))
    for part in (frame.where(F.col("window_end") <= cut), frame.where(F.col("window_end") > cut)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(frame.schema).parquet(source))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


WINDOWS = [("10.0.0.1", 60, 1), ("10.0.0.1", 120, 1), ("10.0.0.1", 180, 4), ("10.0.0.2", 60, 5), ("10.0.0.2", 2000, 1),
           ("10.0.0.2", 2060, 2), ("10.0.1.9", 5000, 1), ("10.0.1.9", 5060, 1)]


@pytest.mark.parametrize("cut", [60, 120, 3000, 9000])
def test_hosts_expire_and_return_cold_wherever_a_run_ends(spark, tmp_path, cut):
    found = seen_in_two_runs(spark, tmp_path, lambda s: host_memory_stream(s, ttl=600), WINDOWS, cut)
    got = sorted((r.ip, r.window_end, r.event, r.tier, r.cold, r.slot, r.flow_count) for r in found.collect())
    assert got == [
        ("10.0.0.1", 60, "seen", "tail", True, "10.0.0.0/24", 1), ("10.0.0.1", 120, "seen", "heavy", True, "10.0.0.0/24", 2),
        ("10.0.0.1", 180, "seen", "heavy", False, "10.0.0.1", 6), ("10.0.0.1", 780, "expired", "heavy", True, "10.0.0.0/24", 6),
        ("10.0.0.2", 60, "seen", "heavy", True, "10.0.0.0/24", 5), ("10.0.0.2", 660, "expired", "heavy", True, "10.0.0.0/24", 5),
        ("10.0.0.2", 2000, "seen", "tail", True, "10.0.0.0/24", 1), ("10.0.0.2", 2060, "seen", "heavy", True, "10.0.0.0/24", 3),
        ("10.0.0.2", 2660, "expired", "heavy", True, "10.0.0.0/24", 3),
        ("10.0.1.9", 5000, "seen", "tail", True, "10.0.1.0/24", 1), ("10.0.1.9", 5060, "seen", "heavy", True, "10.0.1.0/24", 2),
    ]


def test_history_starts_anew_after_its_time_to_live(spark, tmp_path):
    found = seen_in_two_runs(spark, tmp_path, lambda s: host_history_stream(s, ttl=600), WINDOWS[:6], 120)
    got = sorted((r.ip, r.window_end, r.event, r.windows_before, r.mean_flows_before, r.burst) for r in found.collect())
    assert got == [
        ("10.0.0.1", 60, "seen", 0, 0.0, 1.0), ("10.0.0.1", 120, "seen", 1, 1.0, 1.0), ("10.0.0.1", 180, "seen", 2, 1.0, 4.0),
        ("10.0.0.1", 780, "expired", 3, 2.0, None), ("10.0.0.2", 60, "seen", 0, 0.0, 5.0), ("10.0.0.2", 660, "expired", 1, 5.0, None),
        ("10.0.0.2", 2000, "seen", 0, 0.0, 1.0), ("10.0.0.2", 2060, "seen", 1, 1.0, 2.0),
    ]


@pytest.mark.parametrize("tier", ["_history", "_memory", "_subnet"])
def test_a_key_that_is_often_silent_has_one_frame(tier):
    """However often a key expires and returns within a batch, its rows are made at once."""
    import pandas as pd

    from flowloom.streaming import state

    class Kept:
        exists, hasTimedOut, value = False, False, None

        def update(self, value):
            self.value = value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            pass

    step = {"_history": lambda: state._history(100), "_memory": lambda: state._memory(100, 3), "_subnet": lambda: state._subnet(100)}[tier]()
    ends = [1000, 600, 650, 2000]  # silent before 1000 and before 2000
    kept = Kept()
    frames = list(step(("10.0.0.1",), iter([pd.DataFrame({"window_end": ends, "flows_now": [5, 1, 2, 4]})]), kept))
    assert len(frames) == 1
    got = frames[0]
    assert got.window_end.tolist() == [600, 650, 750, 1000, 1100, 2000]
    assert got.event.tolist() == ["seen", "seen", "expired", "seen", "expired", "seen"]
    counts = {"_history": "windows_before", "_memory": "flow_count", "_subnet": "flows_before"}[tier]
    want = {"_history": [0, 1, 2, 0, 1, 0], "_memory": [1, 3, 3, 5, 5, 4], "_subnet": [0, 1, 3, 0, 5, 0]}[tier]
    assert got[counts].tolist() == want
    assert kept.value == {"_history": (1, 4, 2000), "_memory": (4, 2000), "_subnet": (1, 4, 2000)}[tier]
