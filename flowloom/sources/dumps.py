"""Switch flow-table dumps as text lines."""

from pyspark.sql import Column, DataFrame, functions as F


def _found(line: Column, pattern: str, default: str | None = None) -> Column:
    value = F.regexp_extract(line, pattern, 1)
    return F.when(value != "", value).otherwise(F.lit(default))


def parse_dump(lines: DataFrame, text: str = "value") -> DataFrame:
    """One flow per ARP or IPv4 line, other lines are skipped. Works on a batch and on a
    stream; every other input column is kept."""
    line = F.col(text)
    arp = line.contains("arp_spa=") & line.contains("arp_tpa=")
    ipv4 = line.contains("nw_src=") & line.contains("nw_dst=")
    low = F.lower(line)
    src = F.when(arp, _found(line, r"arp_spa=([0-9.]+)")).otherwise(_found(line, r"nw_src=([0-9.]+)"))
    dst = F.when(arp, _found(line, r"arp_tpa=([0-9.]+)")).otherwise(_found(line, r"nw_dst=([0-9.]+)"))
    protocol = (
        F.when(arp, "ARP").when(low.contains("icmp"), "ICMP").when(low.contains("tcp"), "TCP")
        .when(low.contains("udp"), "UDP").otherwise("IP")
    )
    hexed = _found(line, r"tcp_flags=0x([0-9a-fA-F]+)")
    flags = F.coalesce(F.conv(hexed, 16, 10), _found(line, r"tcp_flags=([0-9]+)"), F.lit("0"))
    kept = [F.col(c) for c in lines.columns if c != text]
    rows = lines.where(arp | ipv4).select(
        *kept, src.alias("src_ip"), dst.alias("dst_ip"),
        _found(line, r"tp_src=([0-9]+)", "0").cast("int").alias("src_port"),
        _found(line, r"tp_dst=([0-9]+)", "0").cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        _found(line, r"n_packets=([0-9]+)", "0").cast("bigint").alias("packet_count"),
        _found(line, r"n_bytes=([0-9]+)", "0").cast("bigint").alias("byte_count"),
        F.greatest(_found(line, r"[^a-z_]duration=([0-9.]+)s", "5.0").cast("double"), F.lit(0.001)).alias("duration_sec"),
        flags.cast("int").alias("tcp_flags"), F.lit("ovs").alias("data_source"),
    )
    return rows.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())


def poll_results(lines: DataFrame, dump_id: str, text: str = "value", failed: DataFrame | None = None) -> DataFrame:
    """(dump_id, lines, flows, status): ok, ok_empty, or failed for polls listed in ``failed``."""
    is_flow = (F.col(text).contains("arp_spa=") & F.col(text).contains("arp_tpa=")) | (
        F.col(text).contains("nw_src=") & F.col(text).contains("nw_dst=")
    )
    counts = lines.groupBy(dump_id).agg(F.count_if(F.trim(text) != "").alias("lines"), F.count_if(is_flow).alias("flows"))
    status = F.when(F.col("flows") > 0, "ok").otherwise("ok_empty")
    out = counts.withColumn("status", status)
    if failed is not None:
        lost = failed.select(dump_id).join(out, dump_id, "left_anti").select(
            dump_id, F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("flows"), F.lit("failed").alias("status")
        )
        out = out.unionByName(lost)
    return out
