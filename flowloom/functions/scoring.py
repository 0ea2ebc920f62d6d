"""Scores, bands and probability-array expressions."""

import math

from pyspark.sql import Column, functions as F

from flowloom.constants import EPS


def _or(name: str, default) -> Column:
    value = F.col(name).cast("double")
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(float(default)))


def flow_vector() -> dict[str, Column]:
    """Seven flow inputs of the older contract; one-directional records count as forward."""
    zero = F.lit(0.0)
    packet_count = F.greatest(_or("packet_count", 0), zero)
    byte_count = F.greatest(_or("byte_count", 0), zero)
    duration = F.greatest(_or("duration_sec", 1), F.lit(0.001))
    port = F.least(F.greatest(_or("dst_port", 0), zero), F.lit(65535.0))
    has_syn = F.coalesce(F.col("tcp_flags").cast("int"), F.lit(0)).bitwiseAND(F.lit(2)) > 0
    fwd = F.greatest(_or("fwd_packets", packet_count), zero)
    bwd = F.greatest(_or("bwd_packets", 0), zero)
    fwd_b = F.greatest(_or("fwd_bytes", byte_count), zero)
    bwd_b = F.greatest(_or("bwd_bytes", 0), zero)
    syn = F.greatest(_or("syn_flag_count", has_syn.cast("double")), zero)
    rate = F.greatest(_or("flow_bytes_per_s", byte_count / duration), zero)
    packets, volume = fwd + bwd, fwd_b + bwd_b
    return {
        "fwd_ratio": fwd / (packets + EPS),
        "avg_packet_size": volume / (packets + EPS),
        "connection_rate": F.log1p(packets / duration),
        "port_norm": port / 65535.0,
        "byte_asymmetry": (fwd_b - bwd_b) / (volume + EPS),
        "syn_ratio": F.least(syn / (packets + EPS), F.lit(1.0)),
        "bytes_rate_norm": F.log1p(F.least(rate, F.lit(3e8))) / math.log1p(3e8),
    }


def heuristic_score() -> Column:
    """Additive score of one flow, 0.04 to 0.98, four decimals (half-even)."""
    packets = _or("packet_count", 0)
    given = _or("duration_sec", 1)
    duration = F.greatest(F.when(given == 0, 1.0).otherwise(given), F.lit(0.001))
    port = F.coalesce(F.col("dst_port").cast("int"), F.lit(0))
    flags = F.coalesce(F.col("tcp_flags").cast("int"), F.lit(0))

    def bonus(test, points):
        return F.when(test, points).otherwise(0.0)

    total = (
        F.lit(0.04)
        + F.least(packets / 15000.0, F.lit(0.42))
        + F.least(_or("byte_count", 0) / duration / 8_000_000.0, F.lit(0.28))
        + bonus(port.isin(22, 23, 80, 443, 8080), 0.08)
        + bonus(flags.bitwiseAND(F.lit(2)) > 0, 0.08)
        + bonus((packets > 5000) & (duration < 5), 0.14)
    )
    return F.bround(F.least(total, F.lit(0.98)), 4)


def severity_label(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.50, "warning").otherwise("info")


def severity_number(score: Column) -> Column:
    """1 to 10; ties round to the even number."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(score * 10, 0).cast("int")))


def node_status(score: Column, blocked: Column) -> Column:
    return (
        F.when(blocked, "blocked").when(score >= 0.75, "malicious")
        .when(score >= 0.50, "suspicious").otherwise("normal")
    )


def clamp_score(score: Column) -> Column:
    """Into [0, 1]; a score that is not a number becomes 0."""
    infinite = F.abs(score) == F.lit(float("inf"))
    known = F.when(score.isNull() | F.isnan(score) | infinite, 0.0).otherwise(score)
    return F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0))


def argmax(probs: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def threat(probs: Column) -> Column:
    return 1.0 - F.get(probs, F.lit(0))


def adjusted_argmax(probs: Column, offsets: Column) -> Column:
    """Argmax after adding one offset per class to the log-probabilities."""
    moved = F.zip_with(
        probs, offsets, lambda p, b: F.log(F.greatest(p, F.lit(1e-12))) + b
    )
    return argmax(moved)


def class_map(names: list[str], probs: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), probs)


def alert_id(incident_id: Column) -> Column:
    return F.concat(F.lit("alert-"), incident_id.cast("string"))


def alert_text(attack_type: Column, ip: Column, score: Column) -> Column:
    return F.format_string("%s detected from %s (score: %.2f)", attack_type, ip, score)
