"""Snapshot, result and ledger tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators.ordered import top_in_group

LEDGER_FIELDS = {
    "id": "bigint", "tx_hash": "string", "block_number": "bigint", "incident_hash": "string", "timestamp": "bigint",
    "source_ip": "string", "attack_type": "string", "severity": "int", "is_blocked": "boolean", "gas_used": "bigint",
    "forensics_uri": "string",
}


def append_snapshots(flows: DataFrame, path: str, captured: str = "captured_at") -> None:
    """Append a batch of scored flows, one folder per capture day."""
    rows = flows.withColumn("capture_date", F.to_date(captured))
    rows.write.mode("append").partitionBy("capture_date").parquet(path)


def rehydrate(snapshots: DataFrame, now, seconds: int, order: list[str], limit: int | None = None) -> DataFrame:
    """The newest snapshots of the last seconds. The date filter prunes folders."""
    since = F.lit(now) - F.make_dt_interval(secs=F.lit(float(seconds)))
    recent = snapshots.where((F.col("captured_at") >= since))
    if "capture_date" in snapshots.columns:
        recent = recent.where(F.col("capture_date") >= F.to_date(since))
    ordered = recent.orderBy(F.desc("captured_at"), *order)
    return ordered if limit is None else ordered.limit(limit)


def first_scores(recent: DataFrame, order: list[str]) -> DataFrame:
    """Per source, the score of its newest snapshot."""
    newest = F.min_by("threat_score", F.struct((-F.unix_micros("captured_at")).alias("n"), *order))
    return recent.groupBy("src_ip").agg(newest.alias("score"))


def keep_recent(snapshots: DataFrame, now, hours: int) -> DataFrame:
    return snapshots.where(F.col("captured_at") >= F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))


def purge_snapshots(spark: SparkSession, path: str, kept_path: str, now, hours: int) -> None:
    """Write what retention keeps to a new location; the caller switches over to it."""
    keep_recent(spark.read.parquet(path), now, hours).write.mode("errorifexists").partitionBy("capture_date").parquet(kept_path)


def emit(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def read_ledger(raw: DataFrame) -> DataFrame:
    """Every entry with the same fields, absent ones null; what was read back is confirmed."""
    columns = [
        (F.col(name) if name in raw.columns else F.lit(None)).cast(kind).alias(name) for name, kind in LEDGER_FIELDS.items()
    ]
    return raw.select(*columns, F.lit("confirmed").alias("status"))
