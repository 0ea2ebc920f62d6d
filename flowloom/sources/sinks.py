"""Results of a stream in several formats, committed together.

Every format of a micro-batch is written to a folder that its id names, and the batch counts once a
mark for it stands in the commit folder, which is written last. A batch that failed half-way is
written again from the start; one that is already committed changes nothing. Readers see committed
batches only, so all formats always hold the same batches.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

OPTIONS = {"csv": {"header": True}, "json": {"ignoreNullFields": False}, "parquet": {}}


def window_report(rows: DataFrame) -> DataFrame:
    """One row about a batch: how many result rows it holds."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


@dataclass
class ResultSink:
    """``process`` is the ``foreachBatch`` function. ``report`` makes a small table about a batch from
    its rows, kept as JSON beside the formats."""

    spark: SparkSession
    root: str
    formats: tuple[str, ...] = ("json", "csv")
    report: Callable[[DataFrame], DataFrame] = window_report

    def _folder(self, name: str, batch: int | str) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def committed(self) -> list[int]:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        marks = fs.Path(self._folder("commits", "*") + "/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def process(self, rows: DataFrame, batch: int) -> None:
        if batch in self.committed():
            return
        rows = rows.persist()
        try:
            for kind in self.formats:
                rows.write.mode("overwrite").options(**OPTIONS[kind]).format(kind).save(self._folder(kind, batch))
            self.report(rows).write.mode("overwrite").json(self._folder("report", batch))
            count = rows.agg(F.count(F.lit(1)).alias("n_rows"))
            count.coalesce(1).write.mode("overwrite").json(self._folder("commits", batch))
        finally:
            rows.unpersist()

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of one format, or of ``report``, of all committed batches, with their ``batch``."""
        folders = [self._folder(name, batch) for batch in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        kind = "json" if name == "report" else name
        rows = self.spark.read.schema(schema).options(**(OPTIONS[kind] if kind == "csv" else {})).format(kind).load(folders)
        name = F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1)
        return rows.withColumn("batch", name.cast("bigint"))
