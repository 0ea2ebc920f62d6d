"""Scalar expressions and row-level cleaning over the driver tables."""

from pyspark.sql import functions as F

from flowloom.catalog.registry import query
from flowloom.catalog.tables import (
    CLASSES, CLEAN, FLOWS, HEURISTIC_SQL, INCIDENTS, LEDGER, LIVE, LIVE_SCORED, TIE, clean, flows,
    incidents, ip_int_sql, ledger, live, live_scored, scored, scored_sql, table, token_sql,
    with_sql,
)
from flowloom.constants import NAMED_PORTS, RATE_COLUMNS, FEATURE_COLUMNS, TAXONOMY_LABELS
from flowloom.functions import addresses, clock, digests, ports, scoring
from flowloom.operators import cleaning

K = ", ".join(TIE)

# Odd address text built from the tables: valid, padded, IPv6, short and non-numeric forms.
ODD_IP_SQL = """odd AS (SELECT *, CASE k1 % 7 WHEN 0 THEN src_ip WHEN 1 THEN ' ' || src_ip || ' ' WHEN 2 THEN 'fe80::' || k2
  WHEN 3 THEN '10.0.' || k2 WHEN 4 THEN '172.' || (k1 % 40) || '.0.' || k2 WHEN 5 THEN '192.168.' || (k1 % 300) || '.1'
  ELSE CASE k2 % 5 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '169.254.1.1' WHEN 2 THEN '224.0.0.5' WHEN 3 THEN '10.0.0.255' ELSE '10.0.0.0' END END AS ip FROM flows)"""


def odd(spark, sf):
    s = lambda c: F.col(c).cast("string")
    r = F.col("k1") % 7
    last = F.col("k2") % 5
    ip = (
        F.when(r == 0, F.col("src_ip")).when(r == 1, F.concat(F.lit(" "), "src_ip", F.lit(" ")))
        .when(r == 2, F.concat(F.lit("fe80::"), s("k2"))).when(r == 3, F.concat(F.lit("10.0."), s("k2")))
        .when(r == 4, F.concat(F.lit("172."), (F.col("k1") % 40).cast("string"), F.lit(".0."), s("k2")))
        .when(r == 5, F.concat(F.lit("192.168."), (F.col("k1") % 300).cast("string"), F.lit(".1")))
        .otherwise(F.when(last == 0, "127.0.0.1").when(last == 1, "169.254.1.1").when(last == 2, "224.0.0.5")
                   .when(last == 3, "10.0.0.255").otherwise("10.0.0.0"))
    )
    return flows(spark, sf).withColumn("ip", ip)


PARTS = "len(string_split(ip, '.')) >= 4"
O = lambda i: f"coalesce(TRY_CAST(string_split(ip, '.')[{i}] AS BIGINT), 0)"
IP_INT = f"CASE WHEN {PARTS} THEN {O(1)}*16777216 + {O(2)}*65536 + {O(3)}*256 + {O(4)} ELSE 0 END"
VALID = r"regexp_full_match(trim(ip), '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')"


@query("x01_ipv4_to_int", with_sql(FLOWS, ODD_IP_SQL) + f" SELECT {K}, ip, {IP_INT} AS value FROM odd")
def _(spark, sf):
    return odd(spark, sf).select(*TIE, "ip", addresses.ipv4_to_int(F.col("ip")).alias("value"))


@query("x02_int_to_ipv4", with_sql(FLOWS) + f""" SELECT {K}, (k1*99991 % 256) || '.' || (k3 % 256) || '.' || (k4 % 256) || '.' || (k2 % 256) AS ip FROM flows""")
def _(spark, sf):
    value = (F.col("k1") * 99991 % 256) * 16777216 + F.col("k3") % 256 * 65536 + F.col("k4") % 256 * 256 + F.col("k2") % 256
    return flows(spark, sf).select(*TIE, addresses.int_to_ipv4(value).alias("ip"))


@query("x03_subnet_key", with_sql(FLOWS, ODD_IP_SQL) + f""" SELECT v // 256 * 256 AS subnet24, v // 65536 * 65536 AS subnet16, count(*) AS n
  FROM (SELECT {IP_INT} AS v FROM odd) GROUP BY 1, 2""")
def _(spark, sf):
    v = addresses.ipv4_to_int(F.col("ip"))
    return odd(spark, sf).groupBy(addresses.subnet_key(v, 24).alias("subnet24"), addresses.subnet_key(v, 16).alias("subnet16")).agg(F.count(F.lit(1)).alias("n"))


@query("x04_stable_slot", with_sql(FLOWS) + " SELECT src_ip, count(*) AS n, true AS in_range, 1::BIGINT AS n_slots FROM flows GROUP BY 1")
def _(spark, sf):
    slot = addresses.stable_slot(F.col("src_ip"), 4096)
    return flows(spark, sf).withColumn("slot", slot).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("slot").between(0, 4095)).alias("in_range"),
        F.count_distinct("slot").alias("n_slots"))


@query("x05_port_token", with_sql(FLOWS) + f""", p AS (SELECT *, CASE k1 % 13 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 70000 WHEN 3 THEN 0
  WHEN 4 THEN 65535 WHEN 5 THEN k3 * 31 % 65536 ELSE dst_port END AS port FROM flows)
  SELECT {K}, {token_sql('port')} AS token FROM p""")
def _(spark, sf):
    r = F.col("k1") % 13
    port = (F.when(r == 0, F.lit(None)).when(r == 1, -1).when(r == 2, 70000).when(r == 3, 0).when(r == 4, 65535)
            .when(r == 5, F.col("k3") * 31 % 65536).otherwise(F.col("dst_port")))
    return flows(spark, sf).select(*TIE, ports.port_token(port).alias("token"))


@query("x06_protocol_token", with_sql(FLOWS) + f""" SELECT {K}, CASE k1 % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 7 ELSE
  CASE protocol WHEN 6 THEN 3 WHEN 17 THEN 4 ELSE 2 END END AS token FROM flows""")
def _(spark, sf):
    r = F.col("k1") % 9
    p = F.when(r == 0, 0).when(r == 1, 1).when(r == 2, 99).otherwise(F.col("protocol"))
    return flows(spark, sf).select(*TIE, ports.protocol_token(p).alias("token"))


@query("x07_protocol_number", with_sql(LIVE) + f" SELECT {K}, CASE WHEN k1 % 5 = 0 THEN 0 WHEN protocol = 'tcp' THEN 6 WHEN protocol = 'UDP' THEN 17 ELSE 1 END AS number FROM live")
def _(spark, sf):
    name = F.when(F.col("k1") % 5 == 0, "SCTP").otherwise(F.col("protocol"))
    return live(spark, sf).select(*TIE, ports.protocol_number(name).alias("number"))


FV = {
    "fwd_ratio": "packet_count / (packet_count + 1e-6::DOUBLE)",
    "avg_packet_size": "byte_count / (packet_count + 1e-6::DOUBLE)",
    "connection_rate": "ln(1 + packet_count / duration_sec)",
    "port_norm": "dst_port / 65535.0::DOUBLE",
    "byte_asymmetry": "byte_count / (byte_count + 1e-6::DOUBLE)",
    "syn_ratio": "least((CASE WHEN tcp_flags & 2 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / (packet_count + 1e-6::DOUBLE), 1.0::DOUBLE)",
    "bytes_rate_norm": "ln(1 + least(byte_count / duration_sec, 3e8::DOUBLE)) / ln(1 + 3e8::DOUBLE)",
}


def live_extra(spark, sf):
    return live(spark, sf).withColumns({c: F.lit(None).cast("double") for c in [
        "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_flag_count", "flow_bytes_per_s"]})


@query("x10_flow_vector", with_sql(LIVE) + f" SELECT {K}, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in FV.items()) + " FROM live")
def _(spark, sf):
    v = scoring.flow_vector()
    return live_extra(spark, sf).select(*TIE, *[F.round(e, 6).alias(n) for n, e in v.items()])


@query("x11_heuristic_score", with_sql(LIVE) + f" SELECT {K}, {HEURISTIC_SQL} AS score FROM live")
def _(spark, sf):
    return live_scored(spark, sf).select(*TIE, "score")


@query("x12_severity", with_sql(INCIDENTS) + """ SELECT id, CASE WHEN threat_score >= 0.75 THEN 'critical' WHEN threat_score >= 0.5 THEN 'warning' ELSE 'info' END AS band,
  greatest(1, least(10, CAST(round_even(threat_score * 10, 0) AS INT))) AS severity FROM inc""")
def _(spark, sf):
    s = F.col("threat_score")
    return incidents(spark, sf).select("id", scoring.severity_label(s).alias("band"), scoring.severity_number(s).alias("severity"))


@query("x13_node_status", with_sql(INCIDENTS) + """ SELECT CASE WHEN is_blocked THEN 'blocked' WHEN threat_score >= 0.75 THEN 'malicious'
  WHEN threat_score >= 0.5 THEN 'suspicious' ELSE 'normal' END AS status, count(*) AS n FROM inc GROUP BY 1""")
def _(spark, sf):
    return incidents(spark, sf).groupBy(scoring.node_status(F.col("threat_score"), F.col("is_blocked")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


RAW_TS = "strftime(make_timestamp((t + k1 * 137 % 86400) * 1000000), CASE WHEN year(make_timestamp(t * 1000000)) % 2 = 0 THEN '%-d/%-m/%Y %-I:%M' ELSE '%d/%m/%Y %H:%M:%S' END)"


def raw_times(spark, sf):
    at = F.timestamp_seconds(F.col("t") + F.col("k1") * 137 % 86400)
    even = F.year(F.timestamp_seconds("t")) % 2 == 0
    text = F.when(even, F.date_format(at, "d/M/yyyy h:mm")).otherwise(F.date_format(at, "dd/MM/yyyy HH:mm:ss"))
    return flows(spark, sf).withColumns({"at": at, "even": even, "timestamp": text})


@query("x16_parse_timestamps", with_sql(FLOWS) + f""", r AS (SELECT *, make_timestamp((t + k1 * 137 % 86400) * 1000000) AS ats,
  year(make_timestamp(t * 1000000)) % 2 = 0 AS even FROM flows)
  SELECT {K}, CASE WHEN even THEN date_trunc('minute', ats) - to_hours(12 * (CASE WHEN hour(ats) > 12 THEN 1 WHEN hour(ats) = 0 THEN -1 ELSE 0 END)) ELSE ats END AS ts FROM r""")
def _(spark, sf):
    return clock.parse_timestamps(raw_times(spark, sf), "timestamp").select(*TIE, "ts")


REPAIRED = """r AS (SELECT *, make_timestamp((t + k1 * 137 % 86400) * 1000000) AS ats, year(make_timestamp(t * 1000000)) % 2 = 0 AS even FROM flows),
p AS (SELECT *, CASE WHEN even THEN date_trunc('minute', ats) - to_hours(12 * (CASE WHEN hour(ats) > 12 THEN 1 WHEN hour(ats) = 0 THEN -1 ELSE 0 END)) ELSE ats END AS ts0 FROM r),
d AS (SELECT CAST(ts0 AS DATE) AS day, bool_or(hour(ts0) >= 13) AS is24 FROM p GROUP BY 1),
fx AS (SELECT p.*, NOT is24 AND hour(ts0) BETWEEN 1 AND 7 AS moved FROM p JOIN d ON CAST(ts0 AS DATE) = day)"""


@query("x17_repair_clock", with_sql(FLOWS, REPAIRED) + f" SELECT {K}, moved, CASE WHEN moved THEN ts0 + INTERVAL 12 HOUR ELSE ts0 END AS ts FROM fx")
def _(spark, sf):
    return clock.repair_clock(clock.parse_timestamps(raw_times(spark, sf), "timestamp")).select(*TIE, "moved", "ts")


@query("w08_full_day_clock", with_sql(FLOWS, REPAIRED) + " SELECT day::VARCHAR AS day, is24 AS is_24h FROM d")
def _(spark, sf):
    parsed = clock.parse_timestamps(raw_times(spark, sf), "timestamp")
    return clock.full_day_clock(parsed, "ts", "timestamp").withColumn("day", F.col("day").cast("string"))


@query("x18_epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", clock.epoch_seconds(F.col("ts")).alias("t"))


@query("x19_validate_labels", with_sql(INCIDENTS) + """ SELECT attack_type, count(*) AS n, attack_type <> 'Odd' AS known,
  CASE WHEN attack_type = 'Botnet' THEN 'not enforceable' END AS note FROM inc GROUP BY 1""")
def _(spark, sf):
    from flowloom.operators.incidents import validate_labels
    rows = incidents(spark, sf).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    return validate_labels(rows, CLASSES, {"Botnet": "not enforceable"})


@query("x20_host_order", with_sql(FLOWS) + f""", h AS (SELECT DISTINCT src_ip AS ip FROM flows)
  SELECT ip, 'h' || split_part(ip, '.', 4) AS label, row_number() OVER (ORDER BY {ip_int_sql('ip')}) AS pos FROM h""")
def _(spark, sf):
    from flowloom.operators.ordered import row_ranks
    hosts = flows(spark, sf).select(F.col("src_ip").alias("ip")).distinct().withColumn("key", addresses.ipv4_to_int(F.col("ip")))
    return row_ranks(hosts, [], [F.col("key"), F.col("ip")], "pos").select("ip", addresses.host_label(F.col("ip")).alias("label"), (F.col("pos") + 1).alias("pos"))


@query("x21_json_round_trip", with_sql(LIVE) + f" SELECT {K}, src_ip, dst_ip, packet_count FROM live")
def _(spark, sf):
    text = live(spark, sf).select(*TIE, F.to_json(F.struct("src_ip", "dst_ip", "packet_count")).alias("raw_flow_json"))
    back = F.from_json("raw_flow_json", "src_ip string, dst_ip string, packet_count bigint")
    return text.select(*TIE, back.alias("j")).select(*TIE, "j.*")


@query("x22_hash_form", with_sql(INCIDENTS) + """ SELECT id, CASE WHEN ledger_tx IS NULL THEN NULL WHEN ledger_tx LIKE '0x%' THEN ledger_tx ELSE '0x' || ledger_tx END AS with_prefix,
  regexp_replace(ledger_tx, '^0x', '') AS without_prefix FROM inc""")
def _(spark, sf):
    tx = F.col("ledger_tx")
    return incidents(spark, sf).select("id", digests.with_0x(tx).alias("with_prefix"), digests.without_0x(tx).alias("without_prefix"))


@query("x23_table_fingerprint")
def _(spark, sf):
    f = flows(spark, sf)
    return digests.table_fingerprint(f, f.columns)


@query("x24_ledger_verify", with_sql(LEDGER) + """, s AS (SELECT *, sha256(source_ip || '|' || t || '|' || attack_type || '|' || 5 || '|' || incident_id) AS fp FROM led)
  SELECT incident_id, CASE WHEN incident_id % 17 = 0 THEN 'tampered' ELSE fp END AS fingerprint, incident_id % 17 <> 0 AS intact FROM s""")
def _(spark, sf):
    rows = ledger(spark, sf).withColumn("severity", F.lit(5))
    fp = digests.ledger_fingerprint(F.col("source_ip"), F.col("t"), F.col("attack_type"), F.col("severity"), F.col("incident_id"))
    stored = rows.withColumn("fingerprint", F.when(F.col("incident_id") % 17 == 0, "tampered").otherwise(fp))
    return digests.verify_ledger(stored).select("incident_id", "fingerprint", "intact")


@query("x25_argmax_threat", "WITH " + scored_sql() + f""" SELECT {K}, pred, round(conf, 6) AS conf, round(threat, 6) AS threat,
  CASE WHEN p0 * 2.0501234::DOUBLE > greatest(p1, p2, p3, p4, p5) THEN 0 ELSE pred END AS adjusted, round(p3, 6) AS p_botnet FROM scored""")
def _(spark, sf):
    import math
    p = F.col("probs")
    off = F.array(F.lit(math.log(2.0501234)), *[F.lit(0.0)] * 5)
    return scored(spark, sf).select(
        *TIE, scoring.argmax(p).alias("pred"), F.round(scoring.confidence(p), 6).alias("conf"),
        F.round(scoring.threat(p), 6).alias("threat"), scoring.adjusted_argmax(p, off).alias("adjusted"),
        F.round(scoring.class_map(CLASSES, p)["Botnet"], 6).alias("p_botnet"))


@query("x27_alert_text", with_sql(INCIDENTS) + """ SELECT id, 'alert-' || id AS alert_id,
  format('{} detected from {} (score: {:.2f})', attack_type, source_ip, threat_score + 0.0001::DOUBLE) AS description FROM inc""")
def _(spark, sf):
    return incidents(spark, sf).select("id", scoring.alert_id(F.col("id")).alias("alert_id"),
        scoring.alert_text(F.col("attack_type"), F.col("source_ip"), F.col("threat_score") + 0.0001).alias("description"))


@query("x28_clamp_score", with_sql(INCIDENTS) + """ SELECT id, CASE WHEN id % 10 = 0 THEN 0.0::DOUBLE WHEN id % 10 = 1 THEN 1.0::DOUBLE WHEN id % 10 = 2 THEN 0.0::DOUBLE ELSE threat_score END AS score FROM inc""")
def _(spark, sf):
    r = F.col("id") % 10
    raw = F.when(r == 0, float("nan")).when(r == 1, 7.5).when(r == 2, -3.0).otherwise(F.col("threat_score"))
    return incidents(spark, sf).select("id", scoring.clamp_score(raw).alias("score"))


# ------------------------------------------------------------------ cleaning
RAW_LABELS = ["BENIGN", "DDoS", "PortScan", "Bot", "SSH-Patator", "DoS Hulk", "Heartbleed", "FTP-Patator", "DoS slowloris"]
RAW_LABEL_SQL = "[" + ",".join(f"'{x}'" for x in RAW_LABELS) + "][k3 % 9 + 1]"


def raw_labels(spark, sf, pad=" "):
    names = F.array(*[F.lit(x) for x in RAW_LABELS])
    return flows(spark, sf).withColumn("label", F.concat(F.lit(pad), F.element_at(names, (F.col("k3") % 9 + 1).cast("int")), F.lit(pad))).drop("y")


def _case(tax, column="r"):
    from flowloom.constants import TAXONOMY_CLASSES
    return "CASE " + column + " " + " ".join(f"WHEN '{r}' THEN {TAXONOMY_CLASSES[tax].index(l)}" for r, l in TAXONOMY_LABELS[tax].items()) + " END"


@query("p01_map_labels", with_sql(FLOWS) + f", m AS (SELECT {K}, {RAW_LABEL_SQL} AS r FROM flows) SELECT {K}, {_case('cicids6')} AS y FROM m WHERE {_case('cicids6')} IS NOT NULL")
def _(spark, sf):
    return cleaning.map_labels(raw_labels(spark, sf), "cicids6").select(*TIE, "y")


@query("p02_taxonomies", with_sql(FLOWS) + ", m AS (SELECT " + RAW_LABEL_SQL + " AS r FROM flows), a AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS taxonomy, {_case(t)} AS y FROM m" for t in TAXONOMY_LABELS) + ") SELECT taxonomy, y, count(*) AS n FROM a WHERE y IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    counts = raw_labels(spark, sf, "").groupBy(F.col("label").alias("raw_label")).agg(F.count(F.lit(1)).alias("c"))
    return counts.join(F.broadcast(cleaning.taxonomy_table(spark)), "raw_label").groupBy("taxonomy", "y").agg(F.sum("c").alias("n"))


@query("p03_open_set_labels", with_sql(FLOWS) + f", m AS (SELECT {RAW_LABEL_SQL} AS r FROM flows) SELECT coalesce({_case('cicids6')}, 6) AS y, count(*) AS n FROM m GROUP BY 1")
def _(spark, sf):
    rows = raw_labels(spark, sf).withColumn("label", F.translate("label", "-", "–"))
    return cleaning.map_labels_open_set(rows, "cicids6").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("p04_coerce_numbers", with_sql(FLOWS) + f""" SELECT {K}, fwd_packets, bwd_packets FROM flows WHERE k1 % 10 NOT IN (0, 1, 2)""")
def _(spark, sf):
    r = F.col("k1") % 10
    text = F.when(r == 0, "Infinity").when(r == 1, "NaN").when(r == 2, "n/a").otherwise(F.col("fwd_packets").cast("string"))
    rows = flows(spark, sf).withColumn("fwd_packets", text)
    return cleaning.coerce_numbers(rows, FEATURE_COLUMNS + RATE_COLUMNS, ["src_ip", "dst_ip", "t"]).select(*TIE, "fwd_packets", "bwd_packets")


@query("p05_clean_addresses", with_sql(FLOWS) + f" SELECT {K}, src_ip, dst_ip FROM flows WHERE src_ip <> dst_ip AND k1 % 12 <> 0")
def _(spark, sf):
    rows = flows(spark, sf).withColumns({"src_ip": F.when(F.col("k1") % 12 == 0, "  ").otherwise(F.concat(F.lit(" "), "src_ip")), "dst_ip": F.concat("dst_ip", F.lit("  "))})
    return cleaning.clean_addresses(rows).select(*TIE, "src_ip", "dst_ip")


@query("p06_drop_duplicate_flows", with_sql(FLOWS) + f""", m AS (SELECT *, t // 2592000 * 2592000 AS tm, k1 % 5 AS sp, k3 % 3 AS dp FROM flows)
  SELECT {K} FROM m QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, sp, dp, protocol, tm ORDER BY {K}, t) = 1""")
def _(spark, sf):
    rows = flows(spark, sf).withColumn("t0", F.col("t")).withColumns({
        "t": F.floor(F.col("t") / 2592000) * 2592000, "src_port": F.col("k1") % 5, "dst_port": F.col("k3") % 3})
    return cleaning.drop_duplicate_flows(rows, [*TIE, "t0"]).select(*TIE)


@query("p07_clean_sample", with_sql(FLOWS) + f""", m AS (SELECT *, {RAW_LABEL_SQL} AS r FROM flows WHERE src_ip <> dst_ip)
  SELECT {K}, {_case('flood4')} AS y FROM m WHERE {_case('flood4')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol, t ORDER BY {K}) = 1""")
def _(spark, sf):
    rows = cleaning.map_labels(raw_labels(spark, sf), "flood4")
    return cleaning.clean_flows(rows, FEATURE_COLUMNS + RATE_COLUMNS, TIE).select(*TIE, "y")


@query("p08_validate_records", with_sql(LIVE) + """, v AS (SELECT *, CASE WHEN k1 % 20 = 1 THEN 'src_ip' WHEN k1 % 20 = 2 THEN 'dst_port' WHEN k1 % 20 = 3 THEN 'packet_count'
  WHEN k1 % 20 = 4 THEN 'duration_sec' WHEN k1 % 20 = 5 THEN 'duration_sec' END AS reject_reason FROM live)
  SELECT reject_reason, count(*) AS n FROM v GROUP BY 1""")
def _(spark, sf):
    r = F.col("k1") % 20
    rows = live_extra(spark, sf).withColumns({
        "src_ip": F.when(r == 1, "2001:db8::1").otherwise(F.col("src_ip")),
        "dst_port": F.when(r == 2, 70000).otherwise(F.col("dst_port")),
        "packet_count": F.when(r == 3, -1).otherwise(F.col("packet_count")),
        "duration_sec": F.when(r == 4, 0.0).when(r == 5, float("inf")).otherwise(F.col("duration_sec")),
    })
    return cleaning.validate_records(rows).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("p09_live_to_features", with_sql(LIVE) + f""" SELECT {K}, CASE WHEN protocol = 'tcp' THEN 6 WHEN protocol = 'UDP' THEN 17 ELSE 1 END AS protocol,
  duration_sec * 1e6 AS duration_us, CAST(packet_count AS DOUBLE) AS fwd_packets, 0.0::DOUBLE AS bwd_packets, round(byte_count / duration_sec, 4) AS bytes_per_s,
  CASE WHEN tcp_flags & 2 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS syn, CASE WHEN tcp_flags & 16 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ack,
  CASE WHEN k1 % 15 = 0 THEN 'missing src_ip/dst_ip' END AS map_error FROM live""")
def _(spark, sf):
    rows = live(spark, sf).withColumn("src_ip", F.when(F.col("k1") % 15 != 0, F.col("src_ip")))
    return cleaning.live_to_features(rows, F.col("t")).select(*TIE, "protocol", "duration_us", "fwd_packets", "bwd_packets",
        F.round("bytes_per_s", 4).alias("bytes_per_s"), "syn", "ack", "map_error")


@query("p10_enforceable", with_sql(FLOWS, ODD_IP_SQL) + f""" SELECT ip, coalesce({VALID}, false) AND v BETWEEN 167772161 AND 167772414 AS enforceable, count(*) AS n
  FROM (SELECT ip, {IP_INT} AS v FROM odd) GROUP BY 1, 2""")
def _(spark, sf):
    return odd(spark, sf).groupBy("ip", addresses.is_enforceable(F.col("ip")).alias("enforceable")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_private_addresses", with_sql(FLOWS, ODD_IP_SQL) + f""", m AS (SELECT {IP_INT} AS v FROM odd)
  SELECT v, (v // 16777216 IN (10, 127) OR v // 1048576 = 172*16+1 OR v // 65536 IN (192*256+168, 169*256+254)) AS private, count(*) AS n FROM m GROUP BY 1, 2""")
def _(spark, sf):
    v = addresses.ipv4_to_int(F.col("ip"))
    return odd(spark, sf).groupBy(v.alias("v"), addresses.is_private(v).alias("private")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_allowlist", with_sql(FLOWS, ODD_IP_SQL) + f""" SELECT ip, (NOT {VALID}) OR {IP_INT} BETWEEN 3232235520 AND 3232301055
  OR ip IN (SELECT '10.0.0.' || (s_suppkey % 64 + 1) FROM supplier WHERE s_suppkey <= 5) AS allowlisted, count(*) AS n FROM odd GROUP BY 1, 2""")
def _(spark, sf):
    known = table(spark, sf, "supplier").where(F.col("s_suppkey") <= 5).select(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 64 + 1).cast("string")).alias("ip"))
    return cleaning.allowlisted(odd(spark, sf), "ip", known, ["192.168.0.0/16"]).groupBy("ip", "allowlisted").agg(F.count(F.lit(1)).alias("n"))


GATE = """g AS (SELECT t // 2592000 * 7 + k1 % 20 AS batch, coalesce(CASE WHEN k1 % 20 < 15 THEN 'ovs' ELSE data_source END, 'manual') AS source, k1 FROM live)"""


def gated(spark, sf):
    return live(spark, sf).withColumns({
        "batch": F.floor(F.col("t") / 2592000) * 7 + F.col("k1") % 20,
        "data_source": F.when(F.col("k1") % 20 < 15, "ovs").otherwise(F.col("data_source"))})


@query("p13_provenance_gate", with_sql(LIVE, GATE) + """, b AS (SELECT batch, bool_and(source = 'ovs') AS admitted FROM g GROUP BY 1)
  SELECT batch, source, count(*) AS n_flows, admitted FROM g JOIN b USING (batch) GROUP BY batch, source, admitted""")
def _(spark, sf):
    return cleaning.provenance_gate(gated(spark, sf), "batch")


@query("p13_admitted_flows", with_sql(LIVE, GATE) + """, b AS (SELECT batch FROM g GROUP BY 1 HAVING bool_and(source = 'ovs')) SELECT batch, count(*) AS n FROM g JOIN b USING (batch) GROUP BY 1""")
def _(spark, sf):
    return cleaning.admitted_flows(gated(spark, sf), "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("p14_alert_band", with_sql(INCIDENTS) + """ SELECT id, threat_score FROM inc WHERE threat_score >= 0.5 AND threat_score < 0.75 ORDER BY created_at DESC, id DESC LIMIT 200""")
def _(spark, sf):
    return cleaning.alerts_in_band(incidents(spark, sf), "warning", 200).select("id", "threat_score")


@query("p15_feed_filter", with_sql(INCIDENTS) + """ SELECT id FROM inc WHERE alert_status <> 'resolved' AND threat_score >= 0.5 AND attack_type IN ('DDoS', 'Botnet')
  AND contains(source_ip, '.1') AND created_at >= TIMESTAMP '1998-01-01'""")
def _(spark, sf):
    import datetime
    rows = incidents(spark, sf).withColumn("severity_label", scoring.severity_label(F.col("threat_score")))
    return cleaning.feed_filter(rows, resolved=False, severities=["critical", "warning"], types=["DDoS", "Botnet"], ip_part=".1",
                                since=datetime.datetime(1998, 1, 1)).select("id")


@query("p16_zero_features", with_sql(FLOWS) + f" SELECT {K}, 0.0::DOUBLE AS log_bytes_per_s, round(ln(1 + packets_per_s) / 15.0::DOUBLE, 6) AS log_packets_per_s FROM flows")
def _(spark, sf):
    from flowloom.functions.features import edge_features
    f = edge_features(F.col("t"), F.col("t") + 60)
    rows = flows(spark, sf).withColumns({"dt_pair": F.lit(0.0), "dt_src": F.lit(0.0)}).select(*TIE, f["log_bytes_per_s"].alias("log_bytes_per_s"), F.round(f["log_packets_per_s"], 6).alias("log_packets_per_s"))
    return cleaning.zero_features(rows, ["log_bytes_per_s"])
