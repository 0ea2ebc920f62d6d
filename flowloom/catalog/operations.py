"""Operational views, incidents, ledger and rules over the driver tables."""

import datetime

from pyspark.sql import functions as F

from flowloom.catalog.evaluation import rated, rounded
from flowloom.catalog.graphs import K, r
from flowloom.catalog.registry import query
from flowloom.catalog.tables import (
    ACTIONS, CLASSES, CLEAN, FLOWS, HEURISTIC_SQL, INCIDENTS, LEDGER, LIVE, LIVE_SCORED, SEQ, TIE, actions, clean, flows,
    incidents, ip_int_sql, ledger, live, live_scored, scored_sql, table, windowed, windowed_sql, with_sql,
)
from flowloom.functions import scoring
from flowloom.operators import incidents as inc, rules, views
from flowloom.settings import ServiceLimits

ORDER = ["t", *TIE]
BLOCKED = "blk AS (SELECT DISTINCT source_ip AS ip FROM inc WHERE is_blocked AND threat_score > 0.99)"
SCORES = """sc AS (SELECT ip, greatest(max(score), 0.0::DOUBLE) AS score FROM (SELECT src_ip AS ip, score FROM ls UNION ALL SELECT dst_ip, round_even(score * 0.25::DOUBLE, 4) FROM ls) GROUP BY 1)"""
STATUS = lambda s, b: f"CASE WHEN {b} THEN 'blocked' WHEN {s} >= 0.75 THEN 'malicious' WHEN {s} >= 0.5 THEN 'suspicious' ELSE 'normal' END"


def blocked(spark, sf):
    return incidents(spark, sf).where("is_blocked AND threat_score > 0.99").select(F.col("source_ip").alias("ip")).distinct()


CFG = "cfg AS (SELECT '10.0.0.' || unnest(generate_series(1, 10)) AS ip UNION ALL SELECT '10.0.0.200')"
CONFIGURED = [f"10.0.0.{i}" for i in range(1, 11)] + ["10.0.0.200"]
HOSTS = f"""en AS (SELECT src_ip AS ip, byte_count, coalesce(data_source, 'manual') AS s, t, {K} FROM ls UNION ALL SELECT dst_ip, byte_count, coalesce(data_source, 'manual'), t, {K} FROM ls),
ha AS (SELECT ip, count(*) AS connections, sum(byte_count)::BIGINT AS bytes_total, arg_min(s, (t, {K})) AS data_source FROM en GROUP BY 1),
hz AS (SELECT ip, connections, bytes_total, data_source, 'observed' AS source FROM ha UNION ALL SELECT ip, 0, 0, NULL, 'configured' FROM cfg WHERE ip NOT IN (SELECT ip FROM ha)),
hosts AS (SELECT hz.ip, 'h' || split_part(hz.ip, '.', 4) AS label, round_even(coalesce(score, 0.03::DOUBLE), 4) AS threat_score, connections, bytes_total, blk.ip IS NOT NULL AS is_blocked, source, data_source
  FROM hz LEFT JOIN sc ON sc.ip = hz.ip LEFT JOIN blk ON blk.ip = hz.ip),
host AS (SELECT *, {STATUS('threat_score', 'is_blocked')} AS status FROM hosts)"""
LINKS = f"""lk0 AS (SELECT src_ip, dst_ip, sum(packet_count)::BIGINT AS packet_count, sum(byte_count)::BIGINT AS byte_count, arg_min(coalesce(data_source, 'manual'), (t, {K})) AS data_source FROM ls GROUP BY 1, 2),
link AS (SELECT src_ip AS source, dst_ip AS target, round_even(greatest(coalesce(a.score, 0), coalesce(b.score, 0)), 4) AS value, packet_count, byte_count, data_source FROM lk0 LEFT JOIN sc a ON a.ip = src_ip LEFT JOIN sc b ON b.ip = dst_ip)"""
BASE = with_sql(LIVE_SCORED, INCIDENTS, BLOCKED, SCORES, CFG)


def host_rows(spark, sf):
    ls = live_scored(spark, sf)
    return views.host_table(ls, views.ip_scores(ls), blocked(spark, sf), ORDER, CONFIGURED)


def link_rows(spark, sf):
    ls = live_scored(spark, sf)
    return views.link_table(ls, views.ip_scores(ls), ORDER)


@query("a08_host_table", BASE + ", " + HOSTS + " SELECT * FROM host")
def _(spark, sf):
    return host_rows(spark, sf)


@query("a09_link_table", BASE + ", " + LINKS + " SELECT * FROM link")
def _(spark, sf):
    return link_rows(spark, sf)


@query("a10_dashboard_stats", BASE + ", " + HOSTS + """, c AS (SELECT count(*) AS total_nodes, count(*) FILTER (status IN ('malicious','suspicious')) AS active_threats, count(*) FILTER (status = 'blocked') AS blocked_ips FROM host)
  SELECT *, greatest(0, 100 - active_threats * 12 - blocked_ips * 4) AS system_health, (SELECT sum(packet_count)::BIGINT FROM ls) AS total_packets, (SELECT sum(byte_count)::BIGINT FROM ls) AS total_bytes FROM c""")
def _(spark, sf):
    return views.dashboard_stats(host_rows(spark, sf), live(spark, sf))


@query("a10_flows_per_source", with_sql(LIVE) + " SELECT coalesce(data_source, 'manual') AS data_source, count(*) AS n FROM live GROUP BY 1")
def _(spark, sf):
    return views.flows_per_source(live(spark, sf))


@query("a11_ip_scores", BASE + " SELECT * FROM sc")
def _(spark, sf):
    return views.ip_scores(live_scored(spark, sf))


@query("a11_source_scores", with_sql(LIVE_SCORED) + " SELECT src_ip AS ip, max(score) AS score FROM ls GROUP BY 1")
def _(spark, sf):
    return views.source_scores(live_scored(spark, sf))


NOW = 936921600
TL = f"""sp AS (SELECT unnest(range({NOW} // 86400 * 86400 - 2592000, {NOW} // 86400 * 86400, 86400)) AS time),
tl AS (SELECT time, (SELECT count(*) FROM inc WHERE created >= time AND created < time + 86400) AS threats, (SELECT count(*) FROM act WHERE action = 'block' AND created >= time AND created < time + 86400) AS blocked FROM sp)"""


def line(spark, sf):
    return views.timeline(incidents(spark, sf), actions(spark, sf).where("action = 'block'"), NOW, "30d")


@query("a12_timeline", with_sql(INCIDENTS, ACTIONS, TL) + " SELECT * FROM tl")
def _(spark, sf):
    return line(spark, sf)


@query("a14_spikes", with_sql(INCIDENTS, ACTIONS, TL) + " SELECT * FROM tl WHERE threats >= 5")
def _(spark, sf):
    return views.spikes(line(spark, sf), 5)


@query("a13_alerts_over_time", with_sql(INCIDENTS) + """ SELECT date_trunc('day', created_at)::TIMESTAMP AS time, count(*) AS threats, count(*) FILTER (is_blocked) AS blocked, count(*) FILTER (attack_type = 'DDoS') AS "DDoS",
  count(*) FILTER (attack_type = 'Botnet') AS "Botnet", count(*) FILTER (attack_type NOT IN ('DDoS', 'Botnet')) AS "Unknown" FROM inc GROUP BY 1""")
def _(spark, sf):
    return views.alerts_over_time(incidents(spark, sf), ["DDoS", "Botnet"], True)


@query("a13_alerts_by_hour", with_sql(INCIDENTS) + " SELECT date_trunc('hour', created_at)::TIMESTAMP AS time, count(*) AS threats, count(*) FILTER (is_blocked) AS blocked, count(*) FILTER (attack_type = 'DDoS') AS \"DDoS\", count(*) FILTER (attack_type <> 'DDoS') AS \"Unknown\" FROM inc GROUP BY 1")
def _(spark, sf):
    return views.alerts_over_time(incidents(spark, sf), ["DDoS"], False)


@query("a15_feed_stats", with_sql(INCIDENTS) + " SELECT count(*) AS total, count(*) FILTER (threat_score >= 0.75) AS critical, count(*) FILTER (is_blocked) AS blocked FROM inc")
def _(spark, sf):
    return views.feed_stats(incidents(spark, sf))


@query("a15_counts_per_type", with_sql(INCIDENTS) + " SELECT attack_type, count(*) AS n FROM inc GROUP BY 1")
def _(spark, sf):
    return views.counts_per(incidents(spark, sf), "attack_type")


@query("a16_triage_stats", with_sql(INCIDENTS) + " SELECT count(*) FILTER (alert_status = 'open') AS open, count(*) FILTER (alert_status = 'acknowledged') AS acknowledged, count(*) FILTER (alert_status = 'resolved') AS resolved, round(avg(epoch(acknowledged_at) - epoch(created_at)) FILTER (acknowledged_at > created_at), 4) AS mean_ack_seconds FROM inc")
def _(spark, sf):
    return rounded(views.triage_stats(incidents(spark, sf)), mean_ack_seconds=4)


@query("a17_healing_stats", with_sql(ACTIONS) + f" SELECT round(avg(duration_ms), 4) AS mean_ms, count(*) FILTER (action = 'block' AND created >= {NOW} AND created < {NOW} + 86400) AS isolations_today FROM act")
def _(spark, sf):
    return rounded(views.healing_stats(actions(spark, sf), NOW), mean_ms=4)


@query("a18_ledger_stats", with_sql(LEDGER) + " SELECT sum(coalesce(gas_used, 0))::BIGINT AS total_gas, count(*) FILTER (mined_ok) AS confirmed, max(block_number) AS last_block FROM led")
def _(spark, sf):
    return views.ledger_stats(ledger(spark, sf))


STATE = "CASE status WHEN 'normal' THEN 'healthy' WHEN 'suspicious' THEN 'watching' WHEN 'malicious' THEN 'threat' WHEN 'blocked' THEN 'contained' ELSE 'watching' END"


@query("a19_host_states", BASE + ", " + HOSTS + f" SELECT {STATE} AS state, count(*) AS n FROM host GROUP BY 1")
def _(spark, sf):
    return views.counts_per(views.host_states(host_rows(spark, sf)), "state")


@query("a19_needs_attention", BASE + ", " + HOSTS + f" SELECT ip, {STATE} AS state FROM host WHERE {STATE} <> 'healthy'")
def _(spark, sf):
    return views.needs_attention(host_rows(spark, sf)).select("ip", "state")


@query("a20_links_per_host", with_sql(FLOWS) + ", p AS (SELECT DISTINCT src_ip, dst_ip FROM flows) SELECT ip, count(*) AS edges FROM (SELECT src_ip AS ip FROM p UNION ALL SELECT dst_ip FROM p WHERE src_ip <> dst_ip) GROUP BY 1")
def _(spark, sf):
    links = flows(spark, sf).select(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target")).distinct()
    return views.links_per_host(links)


@query("a20_links_of_host", with_sql(FLOWS) + " SELECT count(*) AS edges FROM (SELECT DISTINCT src_ip, dst_ip FROM flows) WHERE src_ip = '10.0.0.7' OR dst_ip = '10.0.0.7'")
def _(spark, sf):
    links = flows(spark, sf).select(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target")).distinct()
    return views.links_of_host(links, F.lit("10.0.0.7"))


EVW = "ew AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS window_id, value FROM events)"


def event_windows(spark, sf):
    return table(spark, sf, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("window_id"), "value")


@query("a22_window_flags", with_sql(EVW) + " SELECT window_id, count(*) AS n_flows, count(*) FILTER (value >= 20) AS over_gate, count(*) < 8 AS unscored FROM ew GROUP BY 1")
def _(spark, sf):
    return views.window_flags(event_windows(spark, sf), F.col("value") >= 20, 8)


@query("a22_unscored_rate", with_sql(EVW) + ", f AS (SELECT count(*) < 8 AS u FROM ew GROUP BY window_id) SELECT count(*) AS windows, round(avg(u::INT), 6) AS unscored_rate FROM f")
def _(spark, sf):
    return rounded(views.unscored_rate(views.window_flags(event_windows(spark, sf), F.col("value") >= 20, 8)))


# ---------------------------------------------------------------- order, pages
@query("k02_bounded_links", BASE + ", " + LINKS + " SELECT source, target, value, (SELECT count(*) FROM link) AS total, true AS truncated FROM link ORDER BY value DESC, source, target LIMIT 100")
def _(spark, sf):
    return views.bounded_snapshot(link_rows(spark, sf), "value", ["source", "target"], 100).select("source", "target", "value", "total", "truncated")


@query("k02_bounded_hosts", BASE + ", " + HOSTS + " SELECT ip, threat_score, (SELECT count(*) FROM host) AS total, (SELECT count(*) FROM host) > 50 AS truncated FROM host ORDER BY threat_score DESC, ip LIMIT 50")
def _(spark, sf):
    return views.bounded_snapshot(host_rows(spark, sf), "threat_score", ["ip"], 50).select("ip", "threat_score", "total", "truncated")


@query("k03_busiest_flows", with_sql(LIVE) + f" SELECT {K}, batch_id, packet_count FROM live QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY packet_count DESC, {K}) <= 5")
def _(spark, sf):
    return views.busiest_flows(live(spark, sf), "batch_id", TIE, 5).select(*TIE, "batch_id", "packet_count")


@query("k04_top_sources", with_sql(INCIDENTS) + " SELECT source_ip, count(*) AS n FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return views.top_sources(incidents(spark, sf))


@query("k05_page", with_sql(INCIDENTS) + " SELECT id, created, (SELECT count(*) FROM inc) AS total, (SELECT count(*) FROM inc) > 75 AS has_more FROM inc ORDER BY created DESC, id DESC LIMIT 25 OFFSET 50")
def _(spark, sf):
    return views.page(incidents(spark, sf), "created", "id", 25, 50).select("id", "created", "total", "has_more")


@query("k05_page_after", with_sql(INCIDENTS) + " SELECT id, created FROM inc WHERE created < 900000000 OR (created = 900000000 AND id < 500) ORDER BY created DESC, id DESC LIMIT 25")
def _(spark, sf):
    return views.page_after(incidents(spark, sf), "created", "id", 900000000, 500, 25).select("id", "created")


@query("k06_newest_actions", with_sql(ACTIONS) + " SELECT incident_ref, line, k3, k4, k5, created FROM act WHERE ip_address = '10.0.0.9' ORDER BY created DESC, incident_ref DESC, line DESC, k3 DESC, k4 DESC, k5 DESC LIMIT 100")
def _(spark, sf):
    cols = ["incident_ref", "line", "k3", "k4", "k5"]
    return views.newest(actions(spark, sf), ["created", *cols], 100, "10.0.0.9").select(*cols, "created")


@query("k07_oldest_work", with_sql(INCIDENTS) + " SELECT id, ledger_tx FROM inc WHERE ledger_tx IS NOT NULL AND (ledger_status IS NULL OR ledger_status NOT IN ('confirmed','failed','permanent_failure')) ORDER BY id LIMIT 10")
def _(spark, sf):
    s = F.col("ledger_status")
    ok = F.col("ledger_tx").isNotNull() & (s.isNull() | ~s.isin("confirmed", "failed", "permanent_failure"))
    return views.oldest_work(incidents(spark, sf), ok, "id", 10).select("id", "ledger_tx")


@query("k12_latest_events", with_sql(INCIDENTS) + " SELECT id, created FROM inc ORDER BY created DESC, id DESC LIMIT 5")
def _(spark, sf):
    return incidents(spark, sf).orderBy(F.desc("created"), F.desc("id")).limit(5).select("id", "created")


@query("k12_first_per_host", with_sql(LEDGER) + " SELECT source_ip, incident_id FROM led QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY incident_id) <= 5")
def _(spark, sf):
    return views.first_per_host(ledger(spark, sf).select("source_ip", "incident_id"), "source_ip", [F.col("incident_id")])


@query("w11_latest_per_host", with_sql(INCIDENTS) + " SELECT source_ip, id, attack_type, created FROM inc QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY created DESC, id DESC) = 1")
def _(spark, sf):
    return views.latest_per_host(incidents(spark, sf).select("source_ip", "id", "attack_type", "created"), "source_ip", ["created", "id"])


@query("w13_alert_order", with_sql(INCIDENTS) + ", a AS (SELECT id, CASE WHEN threat_score >= 0.75 THEN 'critical' WHEN threat_score >= 0.5 THEN 'warning' ELSE 'info' END AS severity, created_at FROM inc) SELECT id, severity FROM a ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, created_at DESC, id DESC")
def _(spark, sf):
    rows = incidents(spark, sf).withColumn("severity", scoring.severity_label(F.col("threat_score")))
    return views.alert_order(rows).select("id", "severity")


# ------------------------------------------------------------------- set based
VAR = " UNION ALL ".join(f"SELECT {i} AS v, k1, k2, k3, k4, k5, y FROM clean WHERE k1 % {m} <> 0" for i, m in enumerate([3, 4, 5, 7]))


def variants(spark, sf):
    c = clean(spark, sf)
    return [c.where(f"k1 % {m} <> 0") for m in [3, 4, 5, 7]]


@query("u04_common_ids", with_sql(CLEAN) + f" SELECT DISTINCT {K} FROM clean WHERE k1 % 3 <> 0 AND k1 % 4 <> 0 AND k1 % 5 <> 0 AND k1 % 7 <> 0")
def _(spark, sf):
    return views.common_flows(variants(spark, sf), TIE)


@query("j10_common_flows", with_sql(CLEAN) + f", v AS ({VAR}) SELECT {K}, min(y) AS y, min(y) = max(y) AS consistent FROM v GROUP BY {K} HAVING count(DISTINCT v) = 4")
def _(spark, sf):
    return views.common_labelled_flows(variants(spark, sf), TIE)


@query("u05_all_hosts", BASE + " SELECT ip FROM cfg UNION SELECT src_ip FROM ls UNION SELECT dst_ip FROM ls")
def _(spark, sf):
    return host_rows(spark, sf).select("ip")


MERGE = """cu AS (SELECT src_ip AS source, dst_ip AS target, count(*) AS n FROM flows WHERE source_file < '1999' GROUP BY 1, 2), ic AS (SELECT src_ip AS source, dst_ip AS target, count(*) AS n FROM flows WHERE source_file >= '1999' GROUP BY 1, 2)"""


def merge_parts(spark, sf):
    f = flows(spark, sf)
    g = lambda x: x.groupBy(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return g(f.where("source_file < '1999'")), g(f.where("source_file >= '1999'"))


@query("u06_merge_graph", with_sql(FLOWS, MERGE) + " SELECT * FROM ic UNION ALL SELECT * FROM cu WHERE (source, target) NOT IN (SELECT source, target FROM ic)")
def _(spark, sf):
    return views.merge_graph(*merge_parts(spark, sf), ["source", "target"], True)


@query("u06_replace_graph", with_sql(FLOWS, MERGE) + " SELECT * FROM ic")
def _(spark, sf):
    return views.merge_graph(*merge_parts(spark, sf), ["source", "target"], False)


@query("u07_unblock", with_sql(INCIDENTS) + " SELECT source_ip, count(*) AS n, count(*) FILTER (is_blocked AND source_ip <> '10.0.0.7') AS blocked FROM inc GROUP BY 1")
def _(spark, sf):
    closed, _, _ = inc.unblock(incidents(spark, sf), blocked(spark, sf), "10.0.0.7", 0)
    return closed.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_blocked").alias("blocked"))


UPS = """ub AS (SELECT source_ip AS ip, attack_type AS reason, threat_score, created AS blocked_at, id AS seq, id % 2 AS nw FROM inc WHERE is_blocked)"""


@query("u08_upsert_blocks", with_sql(INCIDENTS, UPS) + ", l AS (SELECT * FROM ub QUALIFY row_number() OVER (PARTITION BY ip ORDER BY nw DESC, blocked_at DESC, seq DESC) = 1) SELECT ip, reason, threat_score, (SELECT min(blocked_at) FROM ub WHERE ub.ip = l.ip) AS blocked_at FROM l")
def _(spark, sf):
    b = incidents(spark, sf).where("is_blocked").select(F.col("source_ip").alias("ip"), F.col("attack_type").alias("reason"), "threat_score", F.col("created").alias("blocked_at"), F.col("id").alias("seq"))
    return inc.upsert_blocks(b.where("seq % 2 = 0"), b.where("seq % 2 = 1"))


# ----------------------------------------------------------------------- joins
HEALED = """healed AS (SELECT incident_ref, line, k3, k4, k5, ip_address, 'ISOLATED' AS action, reason, act.created, edges_severed, duration_ms, round(network_stability_before, 4) AS network_stability_before, round(network_stability_after, 4) AS network_stability_after, status AS enforcement_status,
  CASE WHEN attack_type IN ('DDoS','PortScan','SSHBrute','Botnet','DoSHulk','Manual','Heuristic','Unknown') THEN attack_type WHEN reason LIKE '%MANUAL%' THEN 'Manual' WHEN reason LIKE '%GNN%' THEN 'DDoS' ELSE 'Unknown' END AS attack_type,
  round_even(coalesce(threat_score, 0), 4) AS trigger_score FROM act LEFT JOIN inc ON act.incident_id = inc.id WHERE action = 'block')"""
EVENT = ["incident_ref", "line", "k3", "k4", "k5", "ip_address", "action", "reason", "created", "edges_severed", "duration_ms",
         "network_stability_before", "network_stability_after", "enforcement_status", "attack_type", "trigger_score"]


@query("j01_healing_history", with_sql(INCIDENTS, ACTIONS, HEALED) + " SELECT * FROM healed")
def _(spark, sf):
    return rounded(inc.healing_history(actions(spark, sf), incidents(spark, sf)).select(EVENT), network_stability_before=4, network_stability_after=4)


@query("j01_healing_events", with_sql(INCIDENTS, ACTIONS, HEALED) + " SELECT * FROM healed ORDER BY created DESC, incident_ref DESC, line DESC, k3 DESC, k4 DESC, k5 DESC LIMIT 100")
def _(spark, sf):
    """The report of the newest 100."""
    order = ["created", "incident_ref", "line", "k3", "k4", "k5"]
    return rounded(inc.healing_events(actions(spark, sf), incidents(spark, sf), order).select(EVENT), network_stability_before=4, network_stability_after=4)


@query("j03_reconcile_plan", with_sql(INCIDENTS, "src AS (SELECT source_ip AS ip, arg_max(is_blocked, id) AS wanted, count(*) % 2 = 0 AS installed FROM inc GROUP BY 1)") + " SELECT ip, CASE WHEN wanted THEN 'reapply' ELSE 'remove' END AS step FROM src WHERE wanted <> installed")
def _(spark, sf):
    """Sources whose newest incident is blocked, against drop rules of the sources with an even number of incidents."""
    sources = incidents(spark, sf).groupBy("source_ip").agg(F.max_by("is_blocked", "id").alias("wanted"), (F.count(F.lit(1)) % 2 == 0).alias("installed"))
    rule = F.when(F.col("installed"), F.concat(F.lit("cookie=0x0, priority=1000,ip,nw_src="), "source_ip", F.lit(" actions=drop")))
    dump = sources.select(rule.otherwise(F.concat(F.lit("cookie=0x0, priority=10,ip,nw_src="), "source_ip", F.lit(" actions=NORMAL"))).alias("value"))
    return inc.reconcile_plan(sources.where("wanted").select(F.col("source_ip").alias("ip")), inc.installed_blocks(dump))


@query("j06_without_blocked", with_sql(INCIDENTS, BLOCKED) + " SELECT id, CASE WHEN blk.ip IS NOT NULL THEN 'already_blocked' END AS skip_reason FROM inc LEFT JOIN blk ON blk.ip = source_ip")
def _(spark, sf):
    return inc.without_blocked(incidents(spark, sf), blocked(spark, sf)).select("id", "skip_reason")


@query("j08_host_membership", with_sql(CLEAN, "hp AS (SELECT DISTINCT src_ip, CASE WHEN CAST(split_part(src_ip, '.', 4) AS INT) % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM clean)") + f" SELECT {K}, split FROM clean JOIN hp USING (src_ip)")
def _(spark, sf):
    c = clean(spark, sf)
    last = F.element_at(F.split("src_ip", r"\."), -1).cast("int")
    hp = c.select("src_ip").distinct().withColumn("split", F.when(last % 3 == 0, "test").otherwise("train"))
    return c.join(hp, "src_ip").select(*TIE, "split")


@query("j11_allow_networks", with_sql(FLOWS) + f", f AS (SELECT *, {ip_int_sql('dst_ip')} AS v FROM flows) SELECT {K}, v BETWEEN 167772176 AND 167772191 OR v BETWEEN 167772192 AND 167772195 AS allowlisted FROM f")
def _(spark, sf):
    from flowloom.operators.cleaning import allowlisted
    none = spark.createDataFrame([], "ip string")
    return allowlisted(flows(spark, sf), "dst_ip", none, ["10.0.0.16/28", "10.0.0.32/30"]).select(*TIE, "allowlisted")


@query("j13_ledger_match", with_sql(LEDGER) + """ SELECT id, CASE WHEN ledger_tx IS NULL THEN 'no_tx' WHEN led.tx IS NULL THEN 'missing' WHEN lower(contract) <> '0xcafe' THEN 'wrong_contract' WHEN mined_ok THEN 'confirmed' ELSE 'missing' END AS ledger_match,
  CASE WHEN ledger_tx IS NULL THEN 'no_tx' WHEN ledger_status NOT IN ('no_tx', 'submitting') THEN ledger_status ELSE coalesce(ledger_status, 'pending') END AS display_status
  FROM inc LEFT JOIN led ON led.tx = CASE WHEN ledger_tx LIKE '0x%' THEN ledger_tx ELSE '0x' || ledger_tx END""")
def _(spark, sf):
    m = inc.match_ledger(incidents(spark, sf), ledger(spark, sf), "0xCafe")
    return m.withColumn("display_status", inc.ledger_display_status()).select("id", "ledger_match", "display_status")


@query("j14_status_overlay", BASE + ", " + HOSTS + """, al AS (SELECT source_ip AS ip, bool_or(threat_score >= 0.75 AND NOT is_blocked ) AS attacking, bool_or(threat_score >= 0.5 AND threat_score < 0.75) AS infected FROM inc GROUP BY 1),
  ov AS (SELECT unnest(['10.0.0.3', '10.0.0.4']) AS ip, unnest(['normal', 'suspicious']) AS st)
  SELECT host.ip, CASE WHEN st = 'normal' THEN status WHEN st IS NOT NULL THEN st WHEN blk.ip IS NOT NULL AND host.ip <> '10.0.0.9' THEN 'isolated' WHEN attacking THEN 'attacking' WHEN infected THEN 'infected' ELSE status END AS status FROM host LEFT JOIN al USING (ip) LEFT JOIN ov USING (ip) LEFT JOIN blk ON blk.ip = host.ip""")
def _(spark, sf):
    alerts = incidents(spark, sf).withColumn("severity", scoring.severity_label(F.col("threat_score")))
    b = blocked(spark, sf)
    events = b.where("ip <> '10.0.0.9'")
    over = spark.createDataFrame([("10.0.0.3", "normal"), ("10.0.0.4", "suspicious")], "ip string, status string")
    return views.status_overlay(host_rows(spark, sf), alerts, events, b, over).select("ip", "status")


@query("j15_first_incident_since", with_sql(INCIDENTS) + ", rn AS (SELECT id AS run_id, source_ip, created - 40000 AS since FROM inc) SELECT run_id, (SELECT min(id) FROM inc WHERE inc.source_ip = rn.source_ip AND inc.created >= rn.since AND data_source = 'ovs') ::DOUBLE AS incident_id FROM rn")
def _(spark, sf):
    i = incidents(spark, sf)
    runs = i.select(F.col("id").alias("run_id"), "source_ip", (F.col("created") - 40000).alias("since"))
    return inc.first_incident_since(runs, i).select("run_id", F.col("incident_id").cast("double").alias("incident_id"))


@query("j16_scaffold_links", with_sql(FLOWS) + ", h AS (SELECT DISTINCT src_ip AS ip FROM flows), l AS (SELECT DISTINCT src_ip AS source, CASE WHEN k1 % 2 = 0 THEN 's1' ELSE dst_ip END AS target FROM flows) SELECT source, target FROM l UNION (SELECT ip, 's1' FROM h) UNION SELECT 's1', 'c0'")
def _(spark, sf):
    f = flows(spark, sf)
    hosts = f.select(F.col("src_ip").alias("ip")).distinct()
    links = f.select(F.col("src_ip").alias("source"), F.when(F.col("k1") % 2 == 0, "s1").otherwise(F.col("dst_ip")).alias("target")).distinct()
    return views.with_scaffold(hosts, links)[1]


# -------------------------------------------------------------------- incidents
LIMITS = ServiceLimits(threshold=0.9)
EVID = """ev AS (SELECT t AS batch_id, t // 60 AS minute, src_ip, max(score) AS score, count(DISTINCT dst_port) FILTER (dst_port BETWEEN 0 AND 65535) AS n_ports, bool_or(dst_port = 22) AS ssh, sum(packet_count) AS packets,
  sum(CASE WHEN dst_port IN (80, 443, 8080) THEN byte_count ELSE 0 END) AS http, count(DISTINCT dst_ip || ':' || dst_port) AS n_targets FROM ls GROUP BY 1, 2, 3)"""
TYPE = "CASE WHEN ssh AND packets > 250 THEN 'SSHBrute' WHEN n_ports >= 5 THEN 'PortScan' WHEN http > 1000000 THEN 'DoSHulk' WHEN packets > 5000 OR score >= 0.9 THEN 'DDoS' ELSE 'Botnet' END"


@query("x14_attack_type", with_sql(LIVE_SCORED, EVID) + f" SELECT batch_id, src_ip, n_ports, n_targets, {TYPE} AS attack_type FROM ev")
def _(spark, sf):
    e = inc.attack_evidence(live_scored(spark, sf), ["batch_id", "src_ip"])
    return e.select("batch_id", "src_ip", "n_ports", "n_targets", inc.attack_type().alias("attack_type"))


@query("x15_idempotency_key", with_sql(LIVE_SCORED) + """, d AS (SELECT DISTINCT src_ip, dst_ip || ':' || dst_port AS target FROM ls), s AS (SELECT src_ip, count(*) AS n, sum(CAST('0x' || substr(md5(target), 1, 7) AS BIGINT))::BIGINT AS z FROM d GROUP BY 1), m AS (SELECT src_ip, max(score) AS score FROM ls GROUP BY 1)
  SELECT src_ip, sha256(src_ip || '|X|' || format('{:.2f}', score) || '|' || CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'warning' ELSE 'info' END || '|5|' || n || '|' || z) AS idempotency_key FROM s JOIN m USING (src_ip)""")
def _(spark, sf):
    from flowloom.functions.digests import idempotency_key
    e = inc.attack_evidence(live_scored(spark, sf), ["src_ip"])
    key = idempotency_key(F.col("src_ip"), F.lit("X"), F.col("score"), scoring.severity_label(F.col("score")), F.lit("5"), F.col("n_targets"), F.col("target_sum"))
    return e.select("src_ip", key.alias("idempotency_key"))


BATCHED = with_sql(LIVE_SCORED, EVID, INCIDENTS, BLOCKED)


def candidates(spark, sf):
    ls = live_scored(spark, sf).withColumn("minute", F.floor(F.col("t") / 60))
    return inc.incident_candidates(ls, "batch_id", "minute", ServiceLimits(threshold=0.9, cidr="10.0.0.0/27"), blocked(spark, sf))


@query("m07_incident_candidates", BATCHED + f" SELECT batch_id, src_ip, score, {TYPE} AS attack_type, greatest(1, least(10, CAST(round_even(score * 10, 0) AS INT))) AS severity, CASE WHEN CAST(split_part(src_ip, '.', 4) AS INT) > 30 THEN 'outside_range' WHEN src_ip IN (SELECT ip FROM blk) THEN 'already_blocked' END AS skip_reason FROM ev WHERE score >= 0.9")
def _(spark, sf):
    return candidates(spark, sf).select("batch_id", "src_ip", "score", "attack_type", "severity", "skip_reason")


@query("m07_new_incidents", BATCHED + " SELECT batch_id, src_ip FROM ev WHERE score >= 0.9 AND CAST(split_part(src_ip, '.', 4) AS INT) <= 30 AND src_ip NOT IN (SELECT ip FROM blk) AND batch_id % 7 <> 0")
def _(spark, sf):
    c = candidates(spark, sf)
    stored = c.where("batch_id % 7 = 0").select("idempotency_key")
    return inc.new_incidents(c, stored).select("batch_id", "src_ip")


@query("m08_outbox_step", with_sql(LEDGER) + """, o AS (SELECT inc.*, led.mined_ok AS ok, coalesce(ledger_status IN ('confirmed','failed','permanent_failure'), false) AS done, (938000000 - pending_since) >= 180 AS late, retry_count + 1 >= 5 AS last FROM inc LEFT JOIN led ON led.tx = CASE WHEN ledger_tx LIKE '0x%' THEN ledger_tx ELSE '0x' || ledger_tx END)
  SELECT id, CASE WHEN done THEN ledger_status WHEN ledger_tx IS NOT NULL AND ok THEN 'confirmed' WHEN ledger_tx IS NOT NULL AND NOT ok THEN 'failed' WHEN ledger_tx IS NOT NULL AND late AND last THEN 'permanent_failure' WHEN ledger_tx IS NOT NULL AND late THEN 'retry' WHEN ledger_tx IS NOT NULL THEN coalesce(ledger_status, 'pending') ELSE 'submitting' END AS next_status,
  retry_count + (NOT done AND ledger_tx IS NOT NULL AND ok IS NULL AND late)::INT AS next_retry_count FROM o""")
def _(spark, sf):
    return inc.outbox_step(incidents(spark, sf), ledger(spark, sf), 938000000, ServiceLimits()).select("id", "next_status", "next_retry_count")


@query("m09_audit_append", with_sql(ACTIONS) + " SELECT action, reason, count(*) AS n FROM act GROUP BY 1, 2")
def _(spark, sf):
    from flowloom.workspace import new_path
    path = new_path(spark, "audit")
    rows = actions(spark, sf).withColumn("day", F.floor(F.col("created") / 31536000))
    inc.append_log(rows.where("line % 2 = 0"), path)
    inc.append_log(rows.where("line % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("x26_triage_states", with_sql("tr AS (SELECT l_orderkey % 2000 AS incident_id, CAST(epoch(l_shipdate) AS BIGINT) AS t, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS seq, ['open','acknowledged','resolved','acknowledged','resolved','resolved','acknowledged','resolved'][l_partkey % 8 + 1] AS state FROM lineitem)",
    "ls1 AS (SELECT *, max(CASE WHEN state = 'open' THEN t * 4000000000000000::HUGEINT + seq END) OVER (PARTITION BY incident_id) AS re, t * 4000000000000000::HUGEINT + seq AS ord FROM tr)") + """
  SELECT incident_id, arg_max(state, ord) AS alert_status, min(t) FILTER (state IN ('acknowledged','resolved') AND (re IS NULL OR ord > re))::DOUBLE AS acknowledged_at, CASE WHEN arg_max(state, ord) = 'resolved' THEN max(t) FILTER (state = 'resolved' AND (re IS NULL OR ord > re))::DOUBLE END AS resolved_at FROM ls1 GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    states = F.array(*[F.lit(x) for x in ["open", "acknowledged", "resolved", "acknowledged", "resolved", "resolved", "acknowledged", "resolved"]])
    ev = li.select((F.col("l_orderkey") % 2000).alias("incident_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
                   (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"),
                   F.element_at(states, (F.col("l_partkey") % 8 + 1).cast("int")).alias("state"))
    return inc.triage_states(ev).withColumns({c: F.col(c).cast("double") for c in ["acknowledged_at", "resolved_at"]})


@query("a52_ledger_ids_by_host", with_sql(LEDGER) + " SELECT source_ip, incident_id, row_number() OVER (PARTITION BY source_ip ORDER BY incident_id) - 1 AS seq FROM led")
def _(spark, sf):
    return inc.ledger_ids_by_host(ledger(spark, sf))


@query("a52_blocked_now", with_sql(ACTIONS) + ", e AS (SELECT ip_address AS ip, action, created AS t, incident_ref * 1000000 + k3 * 100 + line AS eid FROM act) SELECT ip, arg_max(action, t * 100000000000000::HUGEINT + eid) = 'block' AS blocked FROM e GROUP BY 1")
def _(spark, sf):
    e = actions(spark, sf).select(F.col("ip_address").alias("ip"), F.when(F.col("action") == "block", "isolate").otherwise("release").alias("action"),
                                  F.col("created").alias("t"), (F.col("incident_ref") * 1000000 + F.col("k3") * 100 + F.col("line")).alias("event_id"))
    return inc.blocked_now(e)


# ------------------------------------------------------------------------ rules
POLICY = [("DDoS", "meter", 60, 600, 40000, 0.30, 1000), ("PortScan", "alert_only", 30, 300, 45000, 0.2, None),
          ("Botnet", "drop_port", 120, 1800, 48000, 0.28, None), ("SSHBrute", "drop", 120, 1800, 48000, 0.25, None)]
POL = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}', {i}, {h}, {p}, {m}::DOUBLE)" for c, a, i, h, p, m, _ in POLICY) + ") v(attack_class, action, idle, hard, priority, min_conf))"
ALLOWED = "'10.0.0.5', '10.0.0.6'"
VERD = f"vd AS (SELECT *, ['BENIGN','DDoS','PortScan','Botnet','SSHBrute','DoSHulk'][pred + 1] AS attack_class, conf AS confidence, 1.0::DOUBLE - (k1 % 100) / 100.0::DOUBLE AS src_threat FROM scored WHERE pred > 0)"
RULES = f"""r0 AS (SELECT vd.*, action, idle, hard, priority, min_conf, CASE WHEN action IS NULL THEN 'no_policy' WHEN action = 'alert_only' THEN 'class_suppressed' WHEN confidence < min_conf THEN 'below_floor'
  WHEN src_ip IN ({ALLOWED}) OR dst_ip IN ({ALLOWED}) THEN 'allowlisted' WHEN src_threat < 0.2 THEN 'node_corroboration_absent' END AS reason, CASE WHEN action = 'drop_port' THEN dst_port ELSE -1 END AS kp FROM vd LEFT JOIN pol USING (attack_class)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY window_id, src_ip, dst_ip, protocol, kp ORDER BY confidence DESC, k1, k2, k3, k4, k5) = 1 AS fk FROM r0 WHERE reason IS NULL),
r2 AS (SELECT *, sum(fk::INT) OVER (PARTITION BY window_id ORDER BY confidence DESC, k1, k2, k3, k4, k5 ROWS UNBOUNDED PRECEDING) AS c FROM r1),
r3 AS (SELECT * EXCLUDE (fk, c), CASE WHEN c - fk::INT >= 10 THEN 'rule_cap' WHEN fk THEN 'rule' ELSE 'duplicate' END AS outcome FROM r2 UNION ALL SELECT *, reason FROM r0 WHERE reason IS NOT NULL)"""
RBASE = "WITH " + scored_sql() + ",\n" + POL + ",\n" + VERD + ",\n" + RULES


def verdicts(spark, sf):
    v = rules.flow_verdicts(rated(spark, sf).withColumn("is_real", F.lit(True)), CLASSES)
    return v.where("pred > 0").withColumn("src_threat", 1.0 - (F.col("k1") % 100) / 100.0)


def ruled(spark, sf, cap=10):
    allow = spark.createDataFrame([("10.0.0.5",), ("10.0.0.6",)], "ip string")
    return rules.translate(verdicts(spark, sf), rules.policy_table(spark, POLICY), TIE, allow=allow, corroboration=0.2, cap=cap)


@query("m04_rule_outcomes", RBASE + f" SELECT {K}, window_id, attack_class, outcome FROM r3")
def _(spark, sf):
    return ruled(spark, sf).select(*TIE, "window_id", "attack_class", "outcome")


@query("w10_rules_per_window", RBASE + " SELECT window_id, count(*) FILTER (outcome = 'rule') AS n_rules, count(*) FILTER (outcome = 'rule_cap') AS n_capped, count(*) FILTER (outcome = 'duplicate') AS n_duplicates FROM r3 GROUP BY 1")
def _(spark, sf):
    o = F.col("outcome")
    return ruled(spark, sf).groupBy("window_id").agg(F.count_if(o == "rule").alias("n_rules"), F.count_if(o == "rule_cap").alias("n_capped"), F.count_if(o == "duplicate").alias("n_duplicates"))


@query("a21_withheld_summary", RBASE + " SELECT attack_class, outcome AS reason, count(*) AS n FROM r3 WHERE outcome NOT IN ('rule', 'duplicate') GROUP BY 1, 2")
def _(spark, sf):
    return views.withheld_summary(ruled(spark, sf))


@query("j12_policy_lookup", "WITH " + scored_sql() + ",\n" + POL + ",\n" + VERD + f" SELECT {K}, attack_class, action, priority::DOUBLE AS priority FROM vd LEFT JOIN pol USING (attack_class)")
def _(spark, sf):
    return rules.with_policy(verdicts(spark, sf), rules.policy_table(spark, POLICY)).select(*TIE, "attack_class", "action", F.col("priority").cast("double").alias("priority"))


@query("m01_flow_verdicts", "WITH " + scored_sql() + ",\n" + VERD + f" SELECT {K}, attack_class, round(confidence, 6) AS confidence, round(threat, 6) AS threat FROM vd")
def _(spark, sf):
    return rounded(verdicts(spark, sf).select(*TIE, "attack_class", "confidence", "threat"))


@query("m02_host_detections", "WITH " + scored_sql() + """, nd AS (SELECT window_id, src AS host, max(threat) AS threat FROM scored GROUP BY 1, 2) SELECT window_id, host, round(threat, 6) AS threat, (SELECT count(*) FROM scored s WHERE s.window_id = nd.window_id AND s.src = host) AS out_degree, (SELECT count(*) FROM scored s WHERE s.window_id = nd.window_id AND s.dst = host) AS in_degree FROM nd WHERE threat >= 0.98""")
def _(spark, sf):
    s = rated(spark, sf)
    nodes = s.groupBy("window_id", F.col("src").alias("host")).agg(F.max("threat").alias("threat"))
    return rounded(rules.host_detections(nodes, s, 0.98).select("window_id", "host", "threat", "out_degree", "in_degree"))


@query("m03_policy_coverage", "WITH " + scored_sql() + ",\n" + POL + ",\n" + VERD + " SELECT DISTINCT attack_class, 'no_policy' AS problem FROM vd WHERE attack_class NOT IN (SELECT attack_class FROM pol) UNION ALL SELECT attack_class, 'never_predicted' FROM pol WHERE attack_class NOT IN (SELECT attack_class FROM vd)")
def _(spark, sf):
    return rules.policy_coverage(verdicts(spark, sf), rules.policy_table(spark, POLICY), "BENIGN")


@query("m05_rule_text", RBASE + f""" SELECT {K}, 'ovs-ofctl add-flow br0 "priority=' || priority || ',' || CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END || ',nw_src=' || src_ip || ',nw_dst=' || dst_ip || CASE WHEN protocol IN (6, 17) AND dst_port > 0 THEN ',tp_dst=' || dst_port ELSE '' END || ',idle_timeout=' || idle || ',hard_timeout=' || hard || ',actions=' || CASE WHEN action LIKE 'drop%' THEN 'drop' ELSE 'normal' END || '"' AS command,
  CASE WHEN protocol = 6 THEN dst_port::DOUBLE END AS tcp_dst, CASE WHEN action = 'meter' THEN 'METER' END AS kind FROM r3 WHERE outcome = 'rule'""")
def _(spark, sf):
    text = rules.render_rules(rules.number_rules(ruled(spark, sf), TIE))
    return text.select(*TIE, "command", F.col("match.tcp_dst").cast("double").alias("tcp_dst"), F.col("instruction.type").alias("kind"))


@query("m06_policy_echo", RBASE + " SELECT k1 % 3 <> 0 AND k2 % 2 = 0 AS accepted, count(*) AS n FROM r3 WHERE outcome = 'rule' GROUP BY 1")
def _(spark, sf):
    r0 = ruled(spark, sf).where("outcome = 'rule'").withColumns({"policy_digest": F.when(F.col("k1") % 3 != 0, "abc").otherwise("old"), "dry_run": F.col("k2") % 2 == 0})
    return rules.accept_echo(r0, "abc").groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


FIVE = "src_ip, dst_ip, sp, dst_port, protocol"
TRUTH = f"tru AS (SELECT {FIVE}, min(y) AS ty FROM (SELECT *, k1 % 50 AS sp FROM scored) GROUP BY ALL HAVING min(y) = max(y)), tj AS (SELECT x.*, ty FROM (SELECT *, k1 % 50 AS sp FROM scored) x JOIN tru USING ({FIVE}))"


def sp(df):
    return df.withColumn("src_port", F.col("k1") % 50)


@query("j04_true_labels", "WITH " + scored_sql() + f", {TRUTH} SELECT ty AS y, count(*) AS n FROM tru GROUP BY 1")
def _(spark, sf):
    return rules.true_labels(sp(rated(spark, sf))).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("m10_rule_check", "WITH " + scored_sql() + f", {TRUTH} SELECT ty AS y, pred, count(*) AS n, count(*) FILTER (ty = pred) AS correct, count(*) FILTER (ty = pred AND conf >= 0.3) AS correct_at_floor, round(quantile_cont(conf, 0.5::DOUBLE), 6) AS median_confidence FROM tj GROUP BY 1, 2")
def _(spark, sf):
    s = sp(rated(spark, sf)).withColumn("confidence", F.col("conf"))
    floors = spark.createDataFrame([(k, 0.3) for k in range(6)], "pred int, floor double")
    return rounded(rules.rule_check(s, rules.true_labels(s), floors))


def _nodes_sql():
    from flowloom.catalog.graphs import DELTA_SQL, NODE_SQL
    return NODE_SQL


@query("j02_tabular_rows", "WITH " + _nodes_sql() + f" SELECT {K}, window_id, round(ln(1 + fwd_bytes + bwd_bytes), 6) AS log_total_bytes, round((SELECT dst_port_entropy FROM nb WHERE nb.window_id = w8.window_id AND host = src), 5) AS src_dst_port_entropy, round((SELECT ln(1 + in_degree) FROM nb WHERE nb.window_id = w8.window_id AND host = dst), 5) AS dst_log_in_degree FROM w8")
def _(spark, sf):
    from flowloom.constants import EDGE_FEATURES, NODE_FEATURES
    from flowloom.plans import graph
    from flowloom.settings import WindowOptions
    from flowloom.catalog.tables import WEEK
    nodes, edges = graph.build_graphs(clean(spark, sf), WindowOptions(seconds=WEEK, add_reverse_edges=False), SEQ, ids=TIE)
    rows = rules.tabular_rows(edges, nodes, EDGE_FEATURES, NODE_FEATURES, ids=TIE)
    return rows.select(*TIE, "window_id", r(F.col("log_total_bytes"), "log_total_bytes"), r(F.col("src_dst_port_entropy"), "src_dst_port_entropy", 5), r(F.col("dst_log_in_degree"), "dst_log_in_degree", 5))
