"""Label mapping, coercion, hygiene, de-duplication, validation and gates."""

import hashlib
import ipaddress
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.constants import (
    EDGE_FEATURES, TAXONOMY_CLASSES, TAXONOMY_LABELS, TCP_FLAG_BITS,
)
from flowloom.functions.addresses import ipv4_to_int, is_ipv4_text
from flowloom.functions.ports import protocol_number
from flowloom.functions.scoring import _or


# ---------------------------------------------------------------- taxonomies
def taxonomy_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(taxonomy, raw_label, label, y): at most a few dozen rows, so it may be broadcast."""
    rows = [
        (name, raw, label, TAXONOMY_CLASSES[name].index(label))
        for name in names or TAXONOMY_CLASSES
        for raw, label in TAXONOMY_LABELS[name].items()
    ]
    return spark.createDataFrame(rows, "taxonomy string, raw_label string, label string, y int")


def taxonomy_fingerprint(name: str) -> str:
    body = {"classes": TAXONOMY_CLASSES[name], "map": sorted(TAXONOMY_LABELS[name].items())}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def map_labels(df: DataFrame, taxonomy: str, raw: str = "label") -> DataFrame:
    """Replace the raw label by its class and add ``y``; rows outside the map are dropped."""
    table = taxonomy_table(df.sparkSession, [taxonomy]).drop("taxonomy")
    rows = df.withColumnRenamed(raw, "raw_label").withColumn("raw_label", F.trim("raw_label"))
    return rows.join(F.broadcast(table), "raw_label").drop("raw_label")


def normal_label(label: Column) -> Column:
    """Dashes of any kind and repeated spaces count as one space; case does not matter."""
    return F.lower(F.trim(F.regexp_replace(label, r"[\s\-‐-―�\u0096]+", " ")))


def map_labels_open_set(df: DataFrame, taxonomy: str, raw: str = "label") -> DataFrame:
    """As ``map_labels`` but a family outside the map gets the index after the last class."""
    table = taxonomy_table(df.sparkSession, [taxonomy]).select(
        normal_label(F.col("raw_label")).alias("_norm"), F.col("label").alias("_label"), "y"
    )
    rows = df.withColumn("_norm", normal_label(F.col(raw)))
    joined = rows.join(F.broadcast(table), "_norm", "left").drop("_norm")
    unseen = len(TAXONOMY_CLASSES[taxonomy])
    return joined.withColumns({
        raw: F.coalesce("_label", F.trim(raw)), "y": F.coalesce("y", F.lit(unseen)),
    }).drop("_label")


# ------------------------------------------------------------------ hygiene
def coerce_numbers(df: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    """Text to double, infinities and NaN to null, rows with any null in the set dropped."""
    def clean(name):
        value = F.col(name).try_cast("double")
        bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(~bad, value)

    present = [c for c in columns if c in df.columns]
    out = df.withColumns({c: clean(c) for c in present})
    # one predicate per column: a single many-column test slows the optimizer's constraint
    # inference exponentially in the number of columns
    for name in present + required:
        out = out.where(F.col(name).isNotNull())
    return out


def clean_addresses(df: DataFrame) -> DataFrame:
    trimmed = df.withColumns({"src_ip": F.trim("src_ip"), "dst_ip": F.trim("dst_ip")})
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return trimmed.where((src != "") & (dst != "") & (src != dst))


FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "t"]


def drop_duplicate_flows(df: DataFrame, tie: list[str]) -> DataFrame:
    """Keep the earliest row of each identity and time. ``min_by`` is combined on the map
    side, so copies of one flow never meet in one task as rows."""
    rest = [c for c in df.columns if c not in FLOW_KEY]
    kept = df.groupBy(*FLOW_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*tie)).alias("_first")
    )
    return kept.select(*FLOW_KEY, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(df.columns)


def clean_flows(df: DataFrame, features: list[str], tie: list[str]) -> DataFrame:
    numeric = coerce_numbers(df, features, ["src_ip", "dst_ip", "t"])
    return drop_duplicate_flows(clean_addresses(numeric), tie)


def zero_features(df: DataFrame, names: list[str], known: list[str] | None = None) -> DataFrame:
    unknown = [n for n in names if n not in (known or EDGE_FEATURES)]
    if unknown:
        raise ValueError(f"not a feature: {unknown}")
    return df.withColumns({n: F.lit(0.0) for n in names}) if names else df


# --------------------------------------------------------------- validation
def validate_records(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (null on a valid live flow record)."""
    def finite(name):
        v = F.col(name).cast("double")
        return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))

    def bad_port(name, required):
        port = F.col(name).cast("long")
        off = ~port.between(0, 65535)
        return F.coalesce(off, F.lit(required))

    reason = F.when(~is_ipv4_text(F.col("src_ip")), "src_ip")
    reason = reason.when(~is_ipv4_text(F.col("dst_ip")), "dst_ip")
    reason = reason.when(bad_port("src_port", False), "src_port")
    reason = reason.when(bad_port("dst_port", True), "dst_port")
    counts = ["packet_count", "byte_count", "tcp_flags", "fwd_packets", "bwd_packets",
              "fwd_bytes", "bwd_bytes", "syn_flag_count", "flow_bytes_per_s"]
    for name in [c for c in counts if c in df.columns]:
        reason = reason.when(F.col(name) < 0, name)
    duration = F.coalesce(F.col("duration_sec"), F.lit(1.0))
    reason = reason.when((duration <= 0) | ~F.coalesce(finite("duration_sec"), F.lit(True)), "duration_sec")
    if "flow_bytes_per_s" in df.columns:
        reason = reason.when(~finite("flow_bytes_per_s"), "flow_bytes_per_s")
    return df.withColumn("reject_reason", reason)


def live_to_features(df: DataFrame, observed_at: Column) -> DataFrame:
    """Live records in the units and names of the feature schema. A record without both
    addresses keeps ``map_error``; the caller splits on it."""
    duration = F.greatest(_or("duration_sec", 1), F.lit(1e-3))
    packets = F.greatest(_or("packet_count", 0), F.lit(0.0))
    volume = F.greatest(_or("byte_count", 0), F.lit(0.0))
    flags = F.coalesce(F.col("tcp_flags").cast("int"), F.lit(0))

    def given(name, default):
        return _or(name, default) if name in df.columns else (
            default if isinstance(default, Column) else F.lit(float(default)))

    def blank(name):
        return F.coalesce(F.trim(name) == "", F.lit(True))

    out = {
        "src_ip": F.col("src_ip"), "dst_ip": F.col("dst_ip"),
        "src_port": F.coalesce(F.col("src_port").cast("int"), F.lit(0)),
        "dst_port": F.coalesce(F.col("dst_port").cast("int"), F.lit(0)),
        "protocol": protocol_number(F.col("protocol")),
        "t": observed_at.cast("double"),
        "duration_us": duration * 1e6,
        "fwd_packets": given("fwd_packets", packets), "bwd_packets": given("bwd_packets", 0),
        "fwd_bytes": given("fwd_bytes", volume), "bwd_bytes": given("bwd_bytes", 0),
        "bytes_per_s": volume / duration, "packets_per_s": packets / duration,
        **{name: (flags.bitwiseAND(F.lit(bit)) > 0).cast("double")
           for name, bit in TCP_FLAG_BITS.items()},
        "map_error": F.when(blank("src_ip") | blank("dst_ip"), "missing src_ip/dst_ip"),
    }
    kept = [F.col(c) for c in df.columns if c not in out]
    return df.select(*kept, *[v.alias(k) for k, v in out.items()])


# -------------------------------------------------------------------- gates
def allowlisted(df: DataFrame, ip: str, addresses: DataFrame, networks: list[str]) -> DataFrame:
    """Adds ``allowlisted``: an exact address (equi join), inside a network, or unparseable.

    ``networks`` is configuration: a short list that becomes range predicates."""
    value = ipv4_to_int(F.col(ip))
    spans = [ipaddress.ip_network(n, strict=False) for n in networks]
    in_any = F.lit(False)
    for span in spans:
        in_any = in_any | value.between(int(span.network_address), int(span.broadcast_address))
    unparseable = ~is_ipv4_text(F.col(ip)) if spans else F.lit(False)
    exact = addresses.select(F.col("ip").alias(ip), F.lit(True).alias("_exact")).distinct()
    joined = df.join(exact, ip, "left")
    flag = F.coalesce(F.col("_exact"), F.lit(False)) | in_any | unparseable
    return joined.withColumn("allowlisted", flag).drop("_exact")


def provenance_gate(df: DataFrame, batch: str, source: str = "data_source") -> DataFrame:
    """Per batch and source: how many rows, and whether the whole batch passes. Only batches
    in which every row was captured by the switch pass; a missing tag counts as manual."""
    tag = F.coalesce(F.col(source), F.lit("manual"))
    counts = df.groupBy(batch, tag.alias("source")).agg(F.count(F.lit(1)).alias("n_flows"))
    passes = counts.groupBy(batch).agg(F.bool_and(F.col("source") == "ovs").alias("admitted"))
    return counts.join(passes, batch)


def admitted_flows(df: DataFrame, batch: str, source: str = "data_source") -> DataFrame:
    """Rows of the batches that pass the gate."""
    tag = F.coalesce(F.col(source), F.lit("manual"))
    refused = df.where(tag != "ovs").select(batch).distinct()
    return df.join(refused, batch, "left_anti")


def feed_filter(
    alerts: DataFrame, resolved: bool | None = None, severities: list[str] | None = None,
    types: list[str] | None = None, ip_part: str | None = None, since=None,
) -> DataFrame:
    out = alerts
    if resolved is not None:
        out = out.where((F.col("alert_status") == "resolved") == resolved)
    if severities:
        out = out.where(F.col("severity_label").isin(severities))
    if types:
        out = out.where(F.col("attack_type").isin(types))
    if ip_part:
        out = out.where(F.col("source_ip").contains(ip_part))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    return out


SEVERITY_BANDS = {"critical": (0.75, None), "warning": (0.50, 0.75), "info": (None, 0.50)}


def alerts_in_band(alerts: DataFrame, severity: str | None, limit: int | None = None) -> DataFrame:
    out = alerts
    if severity:
        low, high = SEVERITY_BANDS[severity]
        out = out.where(F.col("threat_score") >= low) if low is not None else out
        out = out.where(F.col("threat_score") < high) if high is not None else out
    ordered = out.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)
