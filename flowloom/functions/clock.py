"""Timestamp parsing and the repair of 12-hour clocks without AM/PM marks."""

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.constants import MERIDIEM_PATTERN, TIMESTAMP_FORMATS
from flowloom.workspace import checked_broadcast


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def pick_format(df: DataFrame, raw: str) -> str:
    """The format that resolves most rows of the whole column; the first one on a tie."""
    text = F.trim(F.col(raw).cast("string"))
    counts = df.agg(*[
        F.count(F.try_to_timestamp(text, F.lit(fmt))).alias(f"f{i}")
        for i, fmt in enumerate(TIMESTAMP_FORMATS)
    ]).first()
    return TIMESTAMP_FORMATS[max(range(len(TIMESTAMP_FORMATS)), key=lambda i: (counts[i], -i))]


def parse_with(text: Column, fmt: str) -> Column:
    """``fmt`` first, then the other day-first forms, then ISO text."""
    rest = [f for f in TIMESTAMP_FORMATS if f != fmt]
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in [fmt, *rest]]
    return F.coalesce(*tries, F.try_to_timestamp(text))


def parse_timestamps(df: DataFrame, raw: str, out: str = "ts", fmt: str | None = None) -> DataFrame:
    text = F.trim(F.col(raw).cast("string"))
    return df.withColumn(out, parse_with(text, fmt or pick_format(df, raw)))


def has_meridiem(raw: Column) -> Column:
    return F.coalesce(raw.rlike(MERIDIEM_PATTERN), F.lit(False))


def full_day_clock(df: DataFrame, ts: str, raw: str) -> DataFrame:
    """One row per day: does any row of it prove a 24-hour clock?"""
    proof = (F.hour(ts) >= 13) | has_meridiem(F.col(raw))
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.bool_or(proof).alias("is_24h"))


def repair_clock(
    df: DataFrame, ts: str = "ts", raw: str = "timestamp", pm_hours: tuple = (1, 7)
) -> DataFrame:
    """Adds ``moved`` and shifts those rows of ``ts`` by 12 hours.

    Rows move on days where nothing shows an hour of 13 or later and no AM/PM mark. The
    day table has one row per calendar day, so it is aggregated first and sent to the rows; a
    capture of a few days would be a few keys in a shuffle.
    """
    days = checked_broadcast(full_day_clock(df, ts, raw), "clock-days")
    flagged = df.withColumn("day", F.to_date(ts)).join(days, "day", "left")
    move = (
        F.col(ts).isNotNull() & ~F.coalesce(F.col("is_24h"), F.lit(False))
        & F.hour(ts).between(*pm_hours)
    )
    moved = flagged.withColumn("moved", F.coalesce(move, F.lit(False)))
    shifted = F.when(F.col("moved"), F.col(ts) + F.expr("INTERVAL 12 HOURS")).otherwise(F.col(ts))
    return moved.withColumn(ts, shifted).drop("day", "is_24h")
