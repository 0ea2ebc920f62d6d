"""Operational views: host and link tables, statistics, timelines, feeds, pages, merges."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.constants import CONFIGURED_HOSTS, STATE_OF_STATUS, STEP_LIMITS, WINDOW_STEPS
from flowloom.functions.addresses import host_label
from flowloom.functions.scoring import node_status

SOURCE = lambda: F.coalesce(F.col("data_source"), F.lit("manual"))


# ---------------------------------------------------------------- score tables
def source_scores(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.col("src_ip").alias("ip")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def ip_scores(flows: DataFrame) -> DataFrame:
    """Own score as a source, a quarter of it as a destination; the larger wins."""
    ends = F.explode(F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("score").alias("score")),
        F.struct(F.col("dst_ip").alias("ip"), F.bround(F.col("score") * 0.25, 4).alias("score")),
    ))
    return flows.select(ends.alias("e")).groupBy("e.ip").agg(
        F.greatest(F.max("e.score"), F.lit(0.0)).alias("score")
    )


# ------------------------------------------------------------------ host graph
def host_table(flows: DataFrame, scores: DataFrame, blocked: DataFrame, order: list[str],
               configured: list[str] = CONFIGURED_HOSTS) -> DataFrame:
    """One row per observed or configured host. ``order`` decides which flow was first."""
    spark = flows.sparkSession
    ends = flows.select(
        F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "byte_count", SOURCE().alias("src"), *order
    )
    seen = ends.groupBy("ip").agg(
        F.count(F.lit(1)).alias("connections"), F.sum(F.coalesce("byte_count", F.lit(0))).alias("bytes_total"),
        F.min_by("src", F.struct(*order)).alias("data_source"),
    ).withColumn("source", F.lit("observed"))
    fixed = spark.createDataFrame([(x,) for x in configured], "ip string")
    missing = fixed.join(seen.select("ip"), "ip", "left_anti").select(
        "ip", F.lit(0).cast("bigint").alias("connections"), F.lit(0).cast("bigint").alias("bytes_total"),
        F.lit(None).cast("string").alias("data_source"), F.lit("configured").alias("source"),
    )
    hosts = seen.unionByName(missing).join(scores, "ip", "left").join(
        blocked.select("ip").distinct().withColumn("_b", F.lit(True)), "ip", "left"
    )
    score = F.bround(F.coalesce("score", F.lit(0.03)), 4)
    is_blocked = F.coalesce("_b", F.lit(False))
    return hosts.select(
        "ip", host_label(F.col("ip")).alias("label"), node_status(score, is_blocked).alias("status"),
        score.alias("threat_score"), "connections", "bytes_total", is_blocked.alias("is_blocked"), "source", "data_source",
    )


def link_table(flows: DataFrame, scores: DataFrame, order: list[str]) -> DataFrame:
    """One row per (source, target); a hot pair is summed on the map side first."""
    links = flows.groupBy("src_ip", "dst_ip").agg(
        F.sum(F.coalesce("packet_count", F.lit(0))).alias("packet_count"),
        F.sum(F.coalesce("byte_count", F.lit(0))).alias("byte_count"),
        F.min_by(SOURCE(), F.struct(*order)).alias("data_source"),
    )
    a = scores.select(F.col("ip").alias("src_ip"), F.col("score").alias("_a"))
    b = scores.select(F.col("ip").alias("dst_ip"), F.col("score").alias("_b"))
    value = F.bround(F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))), 4)
    return links.join(a, "src_ip", "left").join(b, "dst_ip", "left").select(
        F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"), value.alias("value"),
        "packet_count", "byte_count", "data_source",
    )


def dashboard_stats(hosts: DataFrame, flows: DataFrame) -> DataFrame:
    active = F.count_if(F.col("status").isin("malicious", "suspicious"))
    blocked = F.count_if(F.col("status") == "blocked")
    h = hosts.agg(
        F.count(F.lit(1)).alias("total_nodes"), active.alias("active_threats"), blocked.alias("blocked_ips"),
        F.greatest(F.lit(0), 100 - active * 12 - blocked * 4).alias("system_health"),
    )
    f = flows.agg(F.sum("packet_count").alias("total_packets"), F.sum("byte_count").alias("total_bytes"))
    return h.crossJoin(f)


def flows_per_source(flows: DataFrame) -> DataFrame:
    return flows.groupBy(SOURCE().alias("data_source")).agg(F.count(F.lit(1)).alias("n"))


def bounded_snapshot(table: DataFrame, score: str, order: list[str], k: int) -> DataFrame:
    """Top rows by score with the total and a truncated flag."""
    total = table.agg(F.count(F.lit(1)).alias("total"))
    top = table.orderBy(F.desc(score), *order).limit(k)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > k)


def links_of_host(links: DataFrame, host: Column) -> DataFrame:
    return links.where((F.col("source") == host) | (F.col("target") == host)).agg(F.count(F.lit(1)).alias("edges"))


def links_per_host(links: DataFrame) -> DataFrame:
    """Links that blocking each host would sever; a loop counts once."""
    ends = F.array_distinct(F.array("source", "target"))
    return links.select(F.explode(ends).alias("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("edges"))


def merge_graph(current: DataFrame, incoming: DataFrame, keys: list[str], truncated: bool) -> DataFrame:
    """A full snapshot replaces the rows it lacks, a truncated one only updates and adds."""
    if not truncated:
        return incoming
    kept = current.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming)


def with_scaffold(hosts: DataFrame, links: DataFrame, switch="s1", controller="c0"):
    """(nodes, links) with a controller, a switch and one link per host that has none to it."""
    spark = hosts.sparkSession
    infra = spark.createDataFrame([(controller, "controller"), (switch, "switch")], "ip string, kind string")
    nodes = hosts.select("ip").withColumn("kind", F.lit("host")).unionByName(infra.join(hosts, "ip", "left_anti"))
    wanted = hosts.select(F.col("ip").alias("source"), F.lit(switch).alias("target")).unionByName(
        spark.createDataFrame([(switch, controller)], "source string, target string")
    )
    return nodes, links.select("source", "target").unionByName(wanted.join(links, ["source", "target"], "left_anti"))


# -------------------------------------------------------------------- timeline
def window_minutes(text: str) -> tuple[int, int]:
    """Span and step in minutes of a text such as ``7d``, ``90min`` or ``all``."""
    value = (text or "60min").strip().lower()
    if value in WINDOW_STEPS:
        return WINDOW_STEPS[value]
    for unit, size in (("min", 1), ("h", 60), ("d", 1440)):
        if value.endswith(unit) and value[: -len(unit)].isdigit():
            span = int(value[: -len(unit)]) * size
            for limit, step in STEP_LIMITS:
                if 0 < span <= limit:
                    return span, step
    raise ValueError(f"not a window of at most 30 days: {text!r}")


def timeline(incidents: DataFrame, blocks: DataFrame, now: int, window: str = "60min",
             t_incident: str = "created", t_block: str = "created") -> DataFrame:
    """Gap-filled counts per time bucket. ``now`` snaps down to a bucket; events exactly at
    it pass the filter but fall in no point."""
    span, step = (x * 60 for x in window_minutes(window))
    end = now // step * step
    start = end - span
    spark = incidents.sparkSession
    points = -(-span // step)
    spine = spark.range(points).select((F.floor(F.lit(start) / step) + F.col("id")).alias("bucket"), (F.lit(start) + F.col("id") * step).alias("time"))

    def counts(df, t, name):
        inside = df.where(F.col(t).between(start, end))
        return inside.groupBy(F.floor(F.col(t) / step).alias("bucket")).agg(F.count(F.lit(1)).alias(name))

    out = spine.join(counts(incidents, t_incident, "threats"), "bucket", "left").join(
        counts(blocks, t_block, "blocked"), "bucket", "left"
    )
    return out.select("time", F.coalesce("threats", F.lit(0)).alias("threats"), F.coalesce("blocked", F.lit(0)).alias("blocked"))


def spikes(points: DataFrame, threshold: int = 5) -> DataFrame:
    return points.where(F.col("threats") >= threshold)


def alerts_over_time(alerts: DataFrame, types: list[str], daily: bool, created: str = "created_at") -> DataFrame:
    """Counts per hour or day, in all and per type; other types count as Unknown."""
    kind = F.when(F.col("attack_type").isin(*types), F.col("attack_type")).otherwise("Unknown")
    bucket = F.date_trunc("day" if daily else "hour", F.col(created)).alias("time")
    return alerts.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("threats"), F.count_if("is_blocked").alias("blocked"),
        *[F.count_if(kind == t).alias(t) for t in dict.fromkeys([*types, "Unknown"])],
    )


# ----------------------------------------------------------------------- feeds
def feed_stats(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("threat_score") >= 0.75).alias("critical"),
        F.count_if("is_blocked").alias("blocked"),
    )


def counts_per(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_sources(alerts: DataFrame, k: int = 5) -> DataFrame:
    return counts_per(alerts, "source_ip").orderBy(F.desc("n"), "source_ip").limit(k)


def triage_stats(alerts: DataFrame) -> DataFrame:
    """Counts per state, and mean seconds to acknowledge over rows acknowledged strictly
    after they were created."""
    wait = F.unix_micros("acknowledged_at") - F.unix_micros("created_at")
    return alerts.agg(
        F.count_if(F.col("alert_status") == "open").alias("open"),
        F.count_if(F.col("alert_status") == "acknowledged").alias("acknowledged"),
        F.count_if(F.col("alert_status") == "resolved").alias("resolved"),
        (F.avg(F.when(wait > 0, wait)) / 1e6).alias("mean_ack_seconds"),
    )


def healing_stats(actions: DataFrame, day_start: int) -> DataFrame:
    today = (F.col("action") == "block") & (F.col("created") >= day_start) & (F.col("created") < day_start + 86400)
    return actions.agg(F.avg("duration_ms").alias("mean_ms"), F.count_if(today).alias("isolations_today"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.sum(F.coalesce("gas_used", F.lit(0))).alias("total_gas"), F.count_if("mined_ok").alias("confirmed"),
        F.max("block_number").alias("last_block"),
    )


def state_of(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATE_OF_STATUS.items() for x in pair])
    return F.coalesce(table[status], F.lit("watching"))


def host_states(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("state", state_of(F.col("status")))


def needs_attention(hosts: DataFrame) -> DataFrame:
    return host_states(hosts).where(F.col("state") != "healthy")


def status_overlay(hosts: DataFrame, alerts: DataFrame, isolations: DataFrame, blocked: DataFrame,
                   overrides: DataFrame) -> DataFrame:
    """Status of every host from manual overrides, isolation, alerts and its own state.

    A host isolated by an event counts only while it is still blocked. An override of
    ``normal`` falls back to the host's own status."""
    held = isolations.select("ip").distinct().join(blocked.select("ip").distinct(), "ip", "left_semi")
    a = alerts.groupBy(F.col("source_ip").alias("ip")).agg(
        F.bool_or((F.col("severity") == "critical") & ~F.col("is_blocked")).alias("_attacking"),
        F.bool_or(F.col("severity") == "warning").alias("_infected"),
    )
    j = hosts.join(held.withColumn("_iso", F.lit(True)), "ip", "left").join(a, "ip", "left").join(
        overrides.select("ip", F.col("status").alias("_override")), "ip", "left"
    )
    merged = (
        F.when(F.col("_override") == "normal", F.col("status")).when(F.col("_override").isNotNull(), F.col("_override"))
        .when(F.col("_iso"), "isolated").when(F.col("_attacking"), "attacking").when(F.col("_infected"), "infected")
        .otherwise(F.col("status"))
    )
    return j.withColumn("status", merged).select(*hosts.columns)


def latest_per_host(events: DataFrame, ip: str, order: list[str]) -> DataFrame:
    rest = [c for c in events.columns if c != ip]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")
    return events.groupBy(ip).agg(last).select(ip, "_l.*")


def first_per_host(events: DataFrame, ip: str, order: list[Column], k: int = 5) -> DataFrame:
    from flowloom.operators.ordered import top_in_group

    return top_in_group(events, [ip], order, k)


def alert_order(alerts: DataFrame) -> DataFrame:
    """Critical first, then newest."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return alerts.orderBy(rank, F.desc("created_at"), F.desc("id"))


# ----------------------------------------------------------------------- pages
def page(df: DataFrame, newest: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first with the total and whether more follow. Deep pages: see ``page_after``."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(F.desc(newest), F.desc(key)).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def page_after(df: DataFrame, newest: str, key: str, last_newest, last_key, limit: int) -> DataFrame:
    """The page after a known row: a pushed-down filter instead of an offset."""
    at, k = F.lit(last_newest), F.lit(last_key)
    older = (F.col(newest) < at) | ((F.col(newest) == at) & (F.col(key) < k))
    return df.where(older).orderBy(F.desc(newest), F.desc(key)).limit(limit)


def newest(df: DataFrame, order: list[str], limit: int | None = None, ip: str | None = None, column: str = "ip_address") -> DataFrame:
    rows = df.where(F.col(column) == ip) if ip else df
    ordered = rows.orderBy(*[F.desc(c) for c in order])
    return ordered if limit is None else ordered.limit(limit)


def oldest_work(df: DataFrame, eligible: Column, key: str, limit: int) -> DataFrame:
    return df.where(eligible).orderBy(key).limit(limit)


def busiest_flows(flows: DataFrame, batch: str, order: list[str], cap: int) -> DataFrame:
    """Per batch, the flows with most packets when a batch exceeds the cap."""
    from flowloom.operators.ordered import top_in_group

    return top_in_group(flows, [batch], [F.desc("packet_count"), *[F.col(c) for c in order]], cap)


def common_flows(variants: list[DataFrame], ids: list[str]) -> DataFrame:
    """Ids that every variant has."""
    out = variants[0].select(*ids).distinct()
    for v in variants[1:]:
        out = out.intersect(v.select(*ids))
    return out


def common_labelled_flows(variants: list[DataFrame], ids: list[str], label: str = "y") -> DataFrame:
    """(ids, label, consistent) of the ids every variant has, with a label check."""
    every = variants[0].select(*ids, label, F.lit(0).alias("_v"))
    for i, v in enumerate(variants[1:], start=1):
        every = every.unionByName(v.select(*ids, label, F.lit(i).alias("_v")))
    rolled = every.groupBy(*ids).agg(
        F.count_distinct("_v").alias("_n"), F.min(label).alias(label), F.max(label).alias("_hi")
    )
    return rolled.where(F.col("_n") == len(variants)).select(*ids, label, (F.col(label) == F.col("_hi")).alias("consistent"))


# ---------------------------------------------------------------------- health
def window_flags(df: DataFrame, gated: Column, min_edges: int) -> DataFrame:
    per = df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_flows"), F.count_if(gated).alias("over_gate"))
    return per.withColumn("unscored", F.col("n_flows") < min_edges)


def unscored_rate(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).alias("windows"), F.avg(F.col("unscored").cast("double")).alias("unscored_rate"))


def withheld_summary(rules: DataFrame) -> DataFrame:
    kept = ~F.col("outcome").isin("rule", "duplicate")
    return rules.where(kept).groupBy("attack_class", F.col("outcome").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
