"""Event-time windows over a stream, closed by watermark and scored by the batch code.

Each micro-batch is appended to a staging table, keyed by batch id. When the highest event
time, less the allowed delay, passes the end of a window, the staged flows of that window are
scored with the same operators as a batch run. All writes are per batch id and overwrite, so
a batch that is run again leaves the same tables. The only value kept on the driver is the
watermark. Flows of a window that is already closed go to a late table.

Writes are keyed by a mark: twice the batch id, and one more for a flush after that batch. A
flush therefore lies between two batches, and a later run sees what it closed. Staged blocks that
no window can need again, and progress before the last two marks, are deleted.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators.hosts import time_since_contact
from flowloom.operators.views import window_flags

NEVER = -(1 << 60)


def epoch_window(t, seconds: int):
    return F.floor(t / seconds)


def window_results(flows: DataFrame, min_edges: int = 8) -> DataFrame:
    """One row per closed window; windows under the minimum are flagged, not scored."""
    gate = F.col("score") >= 0.75 if "score" in flows.columns else F.lit(False)
    return window_flags(flows, gate, min_edges)


@dataclass
class WindowCloser:
    spark: SparkSession
    root: str
    schema: str
    score: Callable[[DataFrame], DataFrame] = window_results
    seconds: int = 60
    delay: int = 0
    tie: tuple = ()
    delta_scope: str = "none"  # "window": gaps restart in each window; "stream": carried over
    lookback: int = 86400
    block: int = 3600  # windows are staged in folders of this many seconds

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, df: DataFrame, name: str, batch: int, by: list[str] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self._path(name)}/batch={batch}")

    def _exists(self, name: str) -> bool:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _folders(self, name: str) -> list[tuple[str, int]]:
        """(path, number) of the ``key=number`` folders in a folder."""
        if not self._exists(name):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return [(f"{name}/{n}", int(n.split("=")[1])) for n in names if n.split("=")[-1].lstrip("-").isdigit()]

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _purge(self, previous: int) -> None:
        """Drop staged blocks that end before the first open window, less the look-back."""
        if previous == NEVER:
            return
        reach = self.lookback if self.delta_scope == "stream" else 0
        first = (previous // self.seconds * self.seconds - reach) // self.block
        for folder, _ in self._folders("staging"):
            blocks = self._folders(folder)
            old = [name for name, block in blocks if block < first]
            for name in [folder] if len(old) == len(blocks) else old:
                self._delete(name)

    def _advance(self, now: int, mark: int) -> None:
        self._write(self.spark.createDataFrame([(now,)], "watermark bigint"), "progress", mark)
        marks = sorted((m, name) for name, m in self._folders("progress"))
        for _, name in marks[:-2]:
            self._delete(name)

    def watermark(self, before: int | None = None) -> int:
        if not self._exists("progress"):
            return NEVER
        rows = self.spark.read.schema("watermark bigint, batch bigint").parquet(self._path("progress"))
        rows = rows.where(F.col("batch") < before) if before is not None else rows
        top = rows.agg(F.max("watermark")).first()[0]
        return NEVER if top is None else top

    def staged(self, low: int, high: int, batch: int) -> DataFrame:
        """Staged flows of times [low, high). Folder columns prune blocks and later batches."""
        rows = self.spark.read.schema(f"{self.schema}, batch bigint, block bigint").parquet(self._path("staging"))
        rows = rows.where(F.col("batch") <= batch)
        if low > NEVER:
            rows = rows.where((F.col("block") >= low // self.block) & (F.col("t") >= low))
        return rows.where((F.col("block") <= high // self.block) & (F.col("t") < high)).drop("batch", "block")

    def _close(self, previous: int, now: int, batch: int) -> None:
        low = NEVER if previous == NEVER else previous // self.seconds * self.seconds
        high = now // self.seconds * self.seconds
        window = epoch_window(F.col("t"), self.seconds)
        if self.delta_scope == "stream":
            reach = low - self.lookback if low > NEVER else NEVER
            rows = time_since_contact(self.staged(reach, high, batch), list(self.tie))
            rows = rows.where(F.col("t") >= low) if low > NEVER else rows
        else:
            rows = self.staged(low, high, batch)
        rows = rows.withColumns({
            "window_id": window, "window_start": (window * self.seconds).cast("double"),
            "window_end": ((window + 1) * self.seconds).cast("double"),
        })
        if self.delta_scope == "window":
            rows = time_since_contact(rows, list(self.tie), scope=["window_id"])
        self._write(self.score(rows), "results", batch)

    def process(self, flows: DataFrame, batch: int) -> None:
        """The ``foreachBatch`` function."""
        batch = 2 * batch
        previous = self.watermark(batch)
        self._purge(previous)
        fields = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        rows = flows.select(*fields).persist()
        try:
            top = rows.agg(F.max("t")).first()[0]
            if top is None:
                return
            end = (epoch_window(F.col("t"), self.seconds) + 1) * self.seconds
            closed = end <= previous
            self._write(rows.where(closed), "late", batch)
            placed = rows.where(~closed).withColumn("block", F.floor(F.col("t") / self.block))
            self._write(placed, "staging", batch, ["block"])
            now = max(previous, int(top) - self.delay)
            if now // self.seconds > previous // self.seconds:
                self._close(previous, now, batch)
            self._advance(now, batch)
        finally:
            rows.unpersist()

    def flush(self) -> None:
        """Close every window that is still open, after a bounded source ended. Flows that a
        later run brings for these windows are late."""
        marks = [m for _, m in self._folders("progress")]
        if not marks:
            return
        previous, batch = self.watermark(), max(marks) | 1
        top = self.spark.read.schema(f"{self.schema}, batch bigint, block bigint").parquet(self._path("staging")).agg(F.max("t")).first()[0]
        if top is None:
            return
        end = (int(top) // self.seconds + 1) * self.seconds
        if end > previous:
            self._close(previous, end, batch)
            self._advance(end, batch)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(self._path("results")).drop("batch")

    def late(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self._path("late")).drop("batch")


def run_to_end(stream: DataFrame, closer: WindowCloser, checkpoint: str) -> None:
    """Drain a bounded source, then close the tail."""
    query = (
        stream.writeStream.foreachBatch(closer.process).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closer.flush()


def tumbling_counts(stream: DataFrame, seconds: int, delay: str, at: str = "at") -> DataFrame:
    """Pure aggregates need no staging: Spark's own windows with a watermark."""
    return (
        stream.withWatermark(at, delay).groupBy(F.window(at, f"{seconds} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_flows"), F.sum("value").alias("value"))
        .select(F.unix_seconds("_w.start").alias("window_start"), "n_flows", "value")
    )
