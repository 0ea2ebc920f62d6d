"""What the text operators share."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.workspace import new_path


def text_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound what one Arrow batch of whole texts may hold in a Python worker, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that holds dots, blanks or other signs, as a reference."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def byte_views(column: pa.Array) -> list[memoryview]:
    """UTF-8 bytes of every text of a column, without a copy; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written table, and its path for :func:`drop_path`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of steps whose results are now written tables.
    It acts when the driver's garbage is collected, which a quiet driver may put off for long."""
    spark.sparkContext._jvm.System.gc()
