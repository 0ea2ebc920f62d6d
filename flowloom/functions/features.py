"""The 20 flow and 16 host features, as expressions shared by batch and streams."""

from pyspark.sql import Column, functions as F

from flowloom.constants import EDGE_FEATURES, EPS, NODE_FEATURES


def number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def safe_log1p(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column) -> Column:
    """Missing, NaN and infinite values become 0."""
    # NaN sorts above infinity, so one comparison rejects it as well
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(0.0)


def edge_features(window_start: Column, window_end: Column) -> dict[str, Column]:
    packets = number("fwd_packets") + number("bwd_packets")
    volume = number("fwd_bytes") + number("bwd_bytes")
    span = F.greatest(window_end - window_start, F.lit(1.0))
    gaps = number("fwd_iat") + number("bwd_iat")

    def per_packet(flag):
        return clip(number(flag) / (packets + EPS), 0.0, 1.0)

    raw = {
        "log_duration_s": safe_log1p(F.greatest(number("duration_us") / 1e6, F.lit(1e-3))),
        "log_total_packets": safe_log1p(packets),
        "log_total_bytes": safe_log1p(volume),
        "fwd_packet_ratio": number("fwd_packets") / (packets + EPS),
        "byte_asymmetry": (number("fwd_bytes") - number("bwd_bytes")) / (volume + EPS),
        "avg_packet_size": safe_log1p(volume / (packets + EPS)) / 10.0,
        "log_max_fwd_len": safe_log1p(number("fwd_len_max")),
        "log_max_bwd_len": safe_log1p(number("bwd_len_max")),
        "syn_ratio": per_packet("syn"),
        "rst_ratio": per_packet("rst"),
        "ack_ratio": per_packet("ack"),
        "psh_ratio": per_packet("psh"),
        "log_iat_mean": safe_log1p(number("iat_mean") / 1e6),
        "iat_burstiness": (number("fwd_iat") - number("bwd_iat")) / (gaps + EPS),
        "log_dt_since_pair": safe_log1p(number("dt_pair")),
        "log_dt_since_src": safe_log1p(number("dt_src")),
        "window_position": clip((number("t") - window_start) / span, 0.0, 1.0),
        "direction_flag": F.lit(1.0),
        "log_bytes_per_s": safe_log1p(number("bytes_per_s")) / 20.0,
        "log_packets_per_s": safe_log1p(number("packets_per_s")) / 15.0,
    }
    return {name: finite(raw[name]) for name in EDGE_FEATURES}


def node_features() -> dict[str, Column]:
    """From per-host sums (see operators.hosts) to the 16 model inputs."""
    c = F.col
    degree = c("out_degree") + c("in_degree")
    variance = c("sq_dt") - c("mean_dt") * c("mean_dt")
    burst = degree / F.greatest(c("mean_flows_before"), F.lit(1.0))
    raw = {
        "log_out_degree": F.log1p(c("out_degree")),
        "log_in_degree": F.log1p(c("in_degree")),
        "degree_ratio": c("out_degree") / (degree + EPS),
        "log_unique_dst_ips": F.log1p(c("unique_dst_ips")),
        "log_unique_src_ips": F.log1p(c("unique_src_ips")),
        "log_unique_dst_ports": F.log1p(c("unique_dst_ports")),
        "dst_port_entropy": c("dst_port_entropy"),
        "peer_entropy": c("peer_entropy"),
        "reciprocity": c("answered_flows") / F.greatest(c("out_degree"), F.lit(1)),
        "log_total_bytes_out": F.log1p(c("bytes_out")) / 20.0,
        "log_total_bytes_in": F.log1p(c("bytes_in")) / 20.0,
        "mean_inter_flow_dt": F.log1p(F.greatest(c("mean_dt"), F.lit(0.0))),
        "std_inter_flow_dt": F.log1p(F.sqrt(F.greatest(variance, F.lit(0.0)))),
        "is_private_addr": c("is_private").cast("double"),
        "log_windows_seen": F.log1p(c("windows_before")),
        "burst_score": F.log1p(clip(burst, 0.0, 1e6)),
    }
    return {name: finite(raw[name]) for name in NODE_FEATURES}
