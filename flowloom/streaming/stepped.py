"""State that steps once per window: every window is judged by what the windows before it left.

The state is a small table. A step reads the table that the step before wrote, does its work over
the window's rows as a Spark job (rows of one segment may be spread over all tasks), and writes
the next table. Tables are named by micro-batch and window, and a step overwrites its own: a
batch that is run again after a failure starts from the state before it and leaves the same
tables.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class SteppedState:
    """``step(state, rows, window)`` returns the columns of ``initial`` and any number of further
    columns, which are that window's report. A window's rows must come in one micro-batch, as
    closed windows do; a micro-batch may hold several, which step in order."""

    spark: SparkSession
    root: str
    initial: DataFrame
    step: Callable[[DataFrame, DataFrame, int], DataFrame]
    window: str = "window_id"

    def _folder(self, batch: int, window: int) -> str:
        return f"{self.root}/steps/batch={batch}/window={window}"

    def _written(self) -> list[tuple[int, int]]:
        """(batch, window) of every step that was written whole."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        marks = fs.Path(f"{self.root}/steps/batch=*/window=*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        steps = [f.getPath().getParent() for f in found]
        return sorted((int(p.getParent().getName()[6:]), int(p.getName()[7:])) for p in steps)

    def state(self, before: int | None = None) -> DataFrame:
        """The table of the last step, or of the last one before a micro-batch."""
        done = [x for x in self._written() if before is None or x[0] < before]
        if not done:
            return self.initial
        return self.spark.read.parquet(self._folder(*done[-1])).select(*self.initial.columns)

    def process(self, rows: DataFrame, batch: int) -> None:
        """The ``foreachBatch`` function."""
        rows = rows.persist()
        try:
            windows = [r[0] for r in rows.select(self.window).distinct().orderBy(self.window).collect()]
            state = self.state(batch)
            for window in windows:
                after = self.step(state, rows.where(F.col(self.window) == window), window)
                after.write.mode("overwrite").parquet(self._folder(batch, window))
                state = self.spark.read.parquet(self._folder(batch, window)).select(*self.initial.columns)
        finally:
            rows.unpersist()

    def reports(self) -> DataFrame:
        """What every step returned, with ``batch`` and the window's number as ``window``."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/steps")

    def run(self, stream: DataFrame, **trigger) -> None:
        """Follow a stream; without a trigger, until a bounded source ends."""
        query = (
            stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()
