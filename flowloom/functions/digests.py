"""Hashes: idempotency keys, ledger fingerprints, table fingerprints."""

from pyspark.sql import Column, DataFrame, functions as F

HASH_PRIME = 2147483647


def with_0x(value: Column) -> Column:
    return F.when(value.startswith("0x"), value).otherwise(F.concat(F.lit("0x"), value))


def without_0x(value: Column) -> Column:
    return F.regexp_replace(value, "^0x", "")


def ledger_fingerprint(ip: Column, t: Column, label: Column, severity: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in (ip, t, label, severity, key)]), 256)


def verify_ledger(ledger: DataFrame) -> DataFrame:
    again = ledger_fingerprint(
        F.col("source_ip"), F.col("t"), F.col("attack_type"), F.col("severity"), F.col("incident_id")
    )
    return ledger.withColumn("intact", again == F.col("fingerprint"))


def target_digest(target: Column) -> Column:
    """28 bits of a target's md5, to be summed over distinct targets. A sum does not depend
    on order, so no task ever holds one source's whole target list."""
    return F.conv(F.substring(F.md5(target), 1, 7), 16, 10).cast("bigint")


def idempotency_key(
    ip: Column, attack_type: Column, score: Column, severity: Column, minute: Column,
    n_targets: Column, target_sum: Column,
) -> Column:
    parts = [
        ip, attack_type, F.format_string("%.2f", score), severity, minute,
        n_targets.cast("string"), target_sum.cast("string"),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free content sum: changes when any row changes."""
    row = F.xxhash64(*columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_sum"),
    )
