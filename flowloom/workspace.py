"""Shared working tables.

A job that must fix an intermediate result (so that lost executors never re-run a
step with other partition bounds) writes it as Parquet in the folder that the
session names in ``spark.checkpoint.dir`` and reads it back.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="flowloom-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """Write ``df`` once and return a scan of what was written, in a folder for each value of
    ``by`` (the last columns)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def checked_broadcast(df: DataFrame, name: str, max_bytes: int = 32 << 20) -> DataFrame:
    """A narrow lookup table, written once and measured. It is broadcast only when its files
    have at most ``max_bytes``; a larger one is joined by shuffle."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(table) if written_bytes(df.sparkSession, path) <= max_bytes else table


def drop_working_tables(spark: SparkSession) -> None:
    """Delete every working table this application wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    )
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
