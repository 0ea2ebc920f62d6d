"""Packets to flows.

Differences by design from a per-packet table: a packet later than the idle timeout always
starts a new flow, and all packets count as forward. The mean inter-arrival time divides by
the packet count, which counts the first gap as 0.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.constants import TCP_FLAG_BITS

FLOW = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _flag(bit: int) -> Column:
    return F.sum((F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(bit)) > 0).cast("bigint"))


def _finish(flows: DataFrame) -> DataFrame:
    span = F.col("_last") - F.col("t")
    duration = F.greatest(span, F.lit(1e-3))
    return flows.withColumns({
        "bwd_packets": F.lit(0), "bwd_bytes": F.lit(0), "bwd_len_max": F.lit(0), "bwd_iat": F.lit(0.0),
        "duration_us": duration * 1e6, "fwd_iat": span * 1e6, "iat_mean": span / F.col("fwd_packets") * 1e6,
        "bytes_per_s": F.col("fwd_bytes") / duration, "packets_per_s": F.col("fwd_packets") / duration,
    }).drop("_last")


def packets_to_flows(packets: DataFrame, timeout: float = 60.0) -> DataFrame:
    """``packets`` has the five flow columns, ts (double seconds), size and flags.

    Packets are first reduced to distinct (flow, second); idle gaps are then looked for
    between the occupied seconds of a flow, whose number the capture length bounds."""
    seconds = packets.groupBy(*FLOW, F.floor("ts").alias("_sec")).agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"),
        F.max("size").alias("_max"), *[_flag(TCP_FLAG_BITS[f]).alias(f) for f in ("syn", "rst", "ack", "psh")],
    )
    order = Window.partitionBy(*FLOW).orderBy("_sec")
    new = F.coalesce((F.col("_a") - F.lag("_b").over(order) > timeout).cast("int"), F.lit(1))
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sessions = seconds.withColumn("_new", new).withColumn("_run", run)
    flows = sessions.groupBy(*FLOW, "_run").agg(
        F.min("_a").alias("t"), F.max("_b").alias("_last"), F.sum("_n").alias("fwd_packets"),
        F.sum("_bytes").alias("fwd_bytes"), F.max("_max").alias("fwd_len_max"),
        *[F.sum(f).alias(f) for f in ("syn", "rst", "ack", "psh")],
    )
    return _finish(flows).drop("_run")


def packet_stream_to_flows(packets: DataFrame, timeout: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """The streaming form: ``at`` is the event timestamp, a flow is emitted when the
    watermark passes its idle end."""
    keyed = packets.withWatermark("at", delay).groupBy(F.session_window("at", timeout).alias("_w"), *FLOW)
    seconds = F.unix_micros("at") / 1e6
    flows = keyed.agg(
        F.min(seconds).alias("t"), F.max(seconds).alias("_last"), F.count(F.lit(1)).alias("fwd_packets"),
        F.sum("size").alias("fwd_bytes"), F.max("size").alias("fwd_len_max"),
        *[_flag(TCP_FLAG_BITS[f]).alias(f) for f in ("syn", "rst", "ack", "psh")],
    )
    return _finish(flows).drop("_w")
