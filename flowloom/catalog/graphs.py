"""Window graphs over the driver tables: structure, features, labels, history."""

from pyspark.sql import functions as F

from flowloom.catalog.registry import query
from flowloom.catalog.tables import (
    CLEAN, FLOWS, SEQ, TIE, WEEK, clean, flows, ip_int_sql, table, token_sql, windowed, windowed_sql, with_sql,
)
from flowloom.functions import features
from flowloom.operators import hosts
from flowloom.plans import graph
from flowloom.settings import WindowOptions

K = ", ".join(TIE)
WIN = windowed_sql()
OPT = WindowOptions(seconds=WEEK)


def r(expr, name, n=6):
    return F.round(expr, n).alias(name)


# -------------------------------------------------------- reusable SQL blocks
def entropy_sql(src, group, value, name):
    return f"""{name} AS (SELECT {group}, sum(n) AS total, count(*) AS n_distinct, sum(-(n / tot) * ln(n / tot + 1e-6::DOUBLE)) AS entropy
  FROM (SELECT *, sum(n) OVER (PARTITION BY {group}) AS tot FROM (SELECT {group}, {value}, count(*)::DOUBLE AS n FROM {src} GROUP BY {group}, {value})) GROUP BY {group})"""


NODE_SQL = WIN + ",\nw8 AS (SELECT * FROM win QUALIFY count(*) OVER (PARTITION BY window_id) >= 8),\n" + ",\n".join([
    entropy_sql("w8", "window_id, src", "dst_token", "pe"), entropy_sql("w8", "window_id, src", "dst", "de"),
    entropy_sql("w8", "window_id, dst", "src", "se"),
]) + """,
bo AS (SELECT window_id, src, sum(total_bytes) AS b FROM w8 GROUP BY 1, 2),
bi AS (SELECT window_id, dst, sum(total_bytes) AS b FROM w8 GROUP BY 1, 2),
rc AS (SELECT a.window_id, a.src, count(*) AS answered FROM w8 a WHERE EXISTS (SELECT 1 FROM w8 b WHERE b.window_id = a.window_id AND b.src = a.dst AND b.dst = a.src) GROUP BY 1, 2),
ti AS (SELECT window_id, src, sum(g) / greatest(count(*) - 1, 1) AS mean_dt, sum(g * g) / greatest(count(*) - 1, 1) AS sq_dt FROM
  (SELECT window_id, src, coalesce(t - lag(t) OVER (PARTITION BY window_id, src ORDER BY t, k1, k2, k3, k4, k5), 0)::DOUBLE AS g FROM w8) GROUP BY 1, 2),
ho AS (SELECT window_id, src AS host FROM w8 UNION SELECT window_id, dst FROM w8),
nb AS (SELECT ho.window_id, ho.host, coalesce(de.total, 0) AS out_degree, coalesce(se.total, 0) AS in_degree,
  coalesce(de.n_distinct, 0) AS unique_dst_ips, coalesce(se.n_distinct, 0) AS unique_src_ips, coalesce(pe.n_distinct, 0) AS unique_dst_ports,
  coalesce(pe.entropy, 0) AS dst_port_entropy, coalesce(de.entropy, 0) AS peer_entropy, coalesce(bo.b, 0) AS bytes_out, coalesce(bi.b, 0) AS bytes_in,
  coalesce(rc.answered, 0) AS answered_flows, coalesce(mean_dt, 0) AS mean_dt, coalesce(sq_dt, 0) AS sq_dt
  FROM ho LEFT JOIN de ON de.window_id = ho.window_id AND de.src = host LEFT JOIN se ON se.window_id = ho.window_id AND se.dst = host
  LEFT JOIN pe ON pe.window_id = ho.window_id AND pe.src = host LEFT JOIN bo ON bo.window_id = ho.window_id AND bo.src = host
  LEFT JOIN bi ON bi.window_id = ho.window_id AND bi.dst = host LEFT JOIN rc ON rc.window_id = ho.window_id AND rc.src = host
  LEFT JOIN ti ON ti.window_id = ho.window_id AND ti.src = host),
vt AS (SELECT window_id, host, y, count(*) AS n FROM (SELECT window_id, src AS host, y FROM w8 UNION ALL SELECT window_id, dst, y FROM w8) GROUP BY 1, 2, 3),
ny AS (SELECT ho.window_id, ho.host, coalesce(b.y, 0) AS y FROM ho LEFT JOIN
  (SELECT * FROM vt WHERE y > 0 QUALIFY row_number() OVER (PARTITION BY window_id, host ORDER BY n DESC, y) = 1) b ON b.window_id = ho.window_id AND b.host = ho.host),
hist AS (SELECT *, out_degree + in_degree AS flows_now,
  count(*) OVER (PARTITION BY host ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS windows_before,
  coalesce(sum(out_degree + in_degree) OVER (PARTITION BY host ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM nb),
hn AS (SELECT *, past / greatest(windows_before, 1) AS mean_flows_before FROM hist)"""

NODE_FEATURE_SQL = {
    "log_out_degree": "ln(1 + out_degree)", "log_in_degree": "ln(1 + in_degree)",
    "degree_ratio": "out_degree / (out_degree + in_degree + 1e-6::DOUBLE)",
    "log_unique_dst_ips": "ln(1 + unique_dst_ips)", "log_unique_src_ips": "ln(1 + unique_src_ips)",
    "log_unique_dst_ports": "ln(1 + unique_dst_ports)", "dst_port_entropy": "dst_port_entropy", "peer_entropy": "peer_entropy",
    "reciprocity": "answered_flows / greatest(out_degree, 1)",
    "log_total_bytes_out": "ln(1 + bytes_out) / 20", "log_total_bytes_in": "ln(1 + bytes_in) / 20",
    "mean_inter_flow_dt": "ln(1 + mean_dt)", "std_inter_flow_dt": "ln(1 + sqrt(greatest(sq_dt - mean_dt * mean_dt, 0)))",
    "is_private_addr": "1.0::DOUBLE", "log_windows_seen": "ln(1 + windows_before)",
    "burst_score": "ln(1 + least((out_degree + in_degree) / greatest(mean_flows_before, 1), 1e6))",
}

DELTA_SQL = """dl AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY src_ip, dst_ip ORDER BY t, seq), 86400)::DOUBLE AS dt_pair,
  coalesce(t - lag(t) OVER (PARTITION BY src_ip ORDER BY t, seq), 86400)::DOUBLE AS dt_src FROM win)"""
PK = "(fwd_packets + bwd_packets + 1e-6::DOUBLE)"
EDGE_FEATURE_SQL = {
    "log_duration_s": "ln(1 + greatest(duration_us / 1e6, 1e-3))", "log_total_packets": "ln(1 + fwd_packets + bwd_packets)",
    "log_total_bytes": "ln(1 + fwd_bytes + bwd_bytes)", "fwd_packet_ratio": f"fwd_packets / {PK}",
    "byte_asymmetry": "(fwd_bytes - bwd_bytes) / (fwd_bytes + bwd_bytes + 1e-6::DOUBLE)",
    "avg_packet_size": f"ln(1 + (fwd_bytes + bwd_bytes) / {PK}) / 10", "log_max_fwd_len": "ln(1 + fwd_len_max)",
    "log_max_bwd_len": "ln(1 + bwd_len_max)", "syn_ratio": f"least(syn / {PK}, 1)", "rst_ratio": f"least(rst / {PK}, 1)",
    "ack_ratio": f"least(ack / {PK}, 1)", "psh_ratio": f"least(psh / {PK}, 1)", "log_iat_mean": "ln(1 + iat_mean / 1e6)",
    "iat_burstiness": "(fwd_iat - bwd_iat) / (fwd_iat + bwd_iat + 1e-6::DOUBLE)", "log_dt_since_pair": "ln(1 + dt_pair)",
    "log_dt_since_src": "ln(1 + dt_src)",
    "window_position": f"least(greatest((t - (t0 + window_id * {WEEK})) / {WEEK}.0::DOUBLE, 0), 1)", "direction_flag": "1.0::DOUBLE",
    "log_bytes_per_s": "ln(1 + bytes_per_s) / 20", "log_packets_per_s": "ln(1 + packets_per_s) / 15",
}


@query("t01_tumbling_windows", "WITH " + WIN + " SELECT window_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM win GROUP BY 1")
def _(spark, sf):
    return windowed(spark, sf).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("t01_epoch_windows", with_sql(CLEAN) + f" SELECT t // {WEEK} AS window_id, (t // {WEEK} * {WEEK})::DOUBLE AS window_start, count(*) AS n FROM clean GROUP BY 1, 2")
def _(spark, sf):
    return hosts.assign_windows(clean(spark, sf), WEEK, anchor="epoch").groupBy("window_id", "window_start").agg(F.count(F.lit(1)).alias("n"))


@query("t02_sliding_windows", with_sql(CLEAN) + f""", m AS (SELECT min(t) AS t0 FROM clean), w AS (SELECT unnest(generate_series(greatest(CAST(floor((t - t0 - {WEEK * 2}) / {WEEK}.0) AS BIGINT) + 1, 0), (t - t0) // {WEEK})) AS window_id, fwd_bytes FROM clean, m)
  SELECT window_id, count(*) AS n, round(sum(fwd_bytes), 2) AS b FROM w GROUP BY 1""")
def _(spark, sf):
    return hosts.assign_sliding_windows(clean(spark, sf), WEEK * 2, WEEK).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("fwd_bytes"), "b", 2))


@query("w01_time_since_contact", "WITH " + WIN + ", " + DELTA_SQL + f" SELECT {K}, t, dt_pair, dt_src FROM dl")
def _(spark, sf):
    return hosts.time_since_contact(clean(spark, sf), SEQ).select(*TIE, "t", "dt_pair", "dt_src")


@query("w07_window_position", "WITH " + WIN + f" SELECT {K}, round({EDGE_FEATURE_SQL['window_position']}, 6) AS window_position FROM win, wt0")
def _(spark, sf):
    f = windowed(spark, sf).withColumns({"dt_pair": F.lit(0.0), "dt_src": F.lit(0.0)})
    e = features.edge_features(F.col("window_start"), F.col("window_end"))
    return f.select(*TIE, r(e["window_position"], "window_position"))


@query("x08_edge_features", "WITH " + WIN + ", " + DELTA_SQL + f" SELECT {K}, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in EDGE_FEATURE_SQL.items()) + " FROM dl, wt0")
def _(spark, sf):
    rows = hosts.time_since_contact(windowed(spark, sf), SEQ)
    e = features.edge_features(F.col("window_start"), F.col("window_end"))
    return rows.select(*TIE, *[r(v, k) for k, v in e.items()])


@query("a01_node_block", "WITH " + NODE_SQL + """ SELECT window_id, host, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree, unique_dst_ips, unique_src_ips,
  unique_dst_ports, round(bytes_out, 4) AS bytes_out, round(bytes_in, 4) AS bytes_in FROM nb""")
def _(spark, sf):
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    return hosts.node_block(w).select("window_id", "host", "out_degree", "in_degree", "unique_dst_ips", "unique_src_ips", "unique_dst_ports",
                                      r(F.col("bytes_out"), "bytes_out", 4), r(F.col("bytes_in"), "bytes_in", 4))


@query("a02_distinct_peers", "WITH " + WIN + " SELECT window_id, src, count(DISTINCT dst) AS n_distinct FROM win GROUP BY 1, 2")
def _(spark, sf):
    return hosts.grouped_distinct(windowed(spark, sf), ["window_id", "src"], "dst")


@query("a03_port_entropy", "WITH " + WIN + ", " + entropy_sql("win", "window_id, src", "dst_token", "pe") + " SELECT window_id, src, CAST(total AS BIGINT) AS total, n_distinct, round(entropy, 6) AS entropy FROM pe")
def _(spark, sf):
    g = ["window_id", "src"]
    return hosts.distinct_and_entropy(hosts.count_values(windowed(spark, sf), g, ["dst_token"]), g).select(*g, "total", "n_distinct", r(F.col("entropy"), "entropy"))


@query("a03_peer_entropy", "WITH " + WIN + ", " + entropy_sql("win", "window_id, src", "dst", "pe") + " SELECT window_id, src, CAST(total AS BIGINT) AS total, n_distinct, round(entropy, 6) AS entropy FROM pe")
def _(spark, sf):
    g = ["window_id", "src"]
    return hosts.distinct_and_entropy(hosts.count_values(windowed(spark, sf), g, ["dst"]), g).select(*g, "total", "n_distinct", r(F.col("entropy"), "entropy"))


@query("a04_inter_flow_times", "WITH " + NODE_SQL + " SELECT window_id, src, round(mean_dt, 4) AS mean_dt, round(sqrt(greatest(sq_dt - mean_dt * mean_dt, 0)), 2) AS std_dt FROM ti")
def _(spark, sf):
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    x = hosts.inter_flow_times(w, ["window_id", "src"])
    var = F.greatest(F.col("sq_dt") - F.col("mean_dt") * F.col("mean_dt"), F.lit(0.0))
    return x.select("window_id", "src", r(F.col("mean_dt"), "mean_dt", 4), r(F.sqrt(var), "std_dt", 2))


@query("a05_node_labels", "WITH " + NODE_SQL + " SELECT window_id, host, y FROM ny")
def _(spark, sf):
    return hosts.node_labels(hosts.keep_full_windows(windowed(spark, sf), 8))


@query("j05_reciprocity", "WITH " + WIN + """, p AS (SELECT window_id, src, dst, count(*) AS n FROM win GROUP BY 1, 2, 3)
  SELECT a.window_id, a.src, a.dst, a.n, b.src IS NOT NULL AS answered FROM p a LEFT JOIN p b ON a.window_id = b.window_id AND a.src = b.dst AND a.dst = b.src""")
def _(spark, sf):
    return hosts.reciprocity(hosts.count_values(windowed(spark, sf), ["window_id"], ["src", "dst"]))


@query("w02_host_history", "WITH " + NODE_SQL + " SELECT window_id, host, windows_before, round(mean_flows_before, 6) AS mean_flows_before, round((out_degree + in_degree) / greatest(mean_flows_before, 1), 6) AS burst FROM hn")
def _(spark, sf):
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    n = w.select("window_id", F.explode(F.array("src", "dst")).alias("host")).groupBy("window_id", "host").agg(F.count(F.lit(1)).alias("flows_now"))
    h = hosts.host_history(n)
    return h.select("window_id", "host", "windows_before", r(F.col("mean_flows_before"), "mean_flows_before"),
                    r(F.col("flows_now") / F.greatest(F.col("mean_flows_before"), F.lit(1.0)), "burst"))


@query("x09_node_features", "WITH " + NODE_SQL + " SELECT hn.window_id, hn.host, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in NODE_FEATURE_SQL.items()) + ", y FROM hn JOIN ny ON hn.window_id = ny.window_id AND hn.host = ny.host")
def _(spark, sf):
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    n = graph.build_nodes(w)
    return n.select("window_id", "host", *[r(F.col(c), c, 5) for c in NODE_FEATURE_SQL], "y")


@query("a53_host_weights", "WITH " + NODE_SQL + ", d AS (SELECT window_id, host, pow(greatest(out_degree + in_degree, 1), -0.5) AS w FROM nb) SELECT window_id, host, round(least(w / greatest(avg(w) OVER (PARTITION BY window_id), 1e-6), 5), 6) AS weight FROM d")
def _(spark, sf):
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    return hosts.host_weights(hosts.node_block(w)).select("window_id", "host", r(F.col("weight"), "weight"))


@query("g01_graph_nodes", "WITH " + NODE_SQL + " SELECT hn.window_id, '10.0.0.' || hn.host % 256 AS ip, " + ", ".join(f"round({NODE_FEATURE_SQL[k]}, 5) AS {k}" for k in ["dst_port_entropy", "reciprocity", "burst_score", "std_inter_flow_dt"]) + ", y FROM hn JOIN ny ON hn.window_id = ny.window_id AND hn.host = ny.host")
def _(spark, sf):
    nodes, _ = graph.build_graphs(clean(spark, sf), OPT, SEQ, ids=TIE)
    return nodes.select("window_id", "ip", *[r(F.col(c), c, 5) for c in ["dst_port_entropy", "reciprocity", "burst_score", "std_inter_flow_dt"]], "y")


@query("g01_graph_edges", "WITH " + WIN + ", " + DELTA_SQL + f""", e AS (SELECT *, {", ".join(f"round({EDGE_FEATURE_SQL[k]}, 6) AS {k}" for k in ["log_total_bytes", "log_dt_since_pair", "window_position"])} FROM dl, wt0 QUALIFY count(*) OVER (PARTITION BY window_id) >= 8)
  SELECT {K}, window_id, src, dst, dst_token, log_total_bytes, log_dt_since_pair, window_position, 1.0::DOUBLE AS direction_flag, true AS is_real FROM e
  UNION ALL SELECT {K}, window_id, dst, src, dst_token, log_total_bytes, log_dt_since_pair, window_position, 0.0::DOUBLE, false FROM e""")
def _(spark, sf):
    _, edges = graph.build_graphs(clean(spark, sf), OPT, SEQ, ids=TIE)
    return edges.select(*TIE, "window_id", "src", "dst", "dst_token", *[r(F.col(c), c) for c in ["log_total_bytes", "log_dt_since_pair", "window_position"]], "direction_flag", "is_real")


FINE = WindowOptions(seconds=1800)


@query("g01_small_windows", with_sql(windowed_sql(1800)) + " SELECT window_id, count(*) AS n_flows, 'unscored' AS status FROM win GROUP BY 1 HAVING count(*) < 8")
def _(spark, sf):
    """Windows that no graph has, as every window is in one table or the other."""
    return graph.small_windows(clean(spark, sf), FINE)


@query("a06_graph_summary", "WITH " + NODE_SQL + """, n AS (SELECT window_id, count(*) AS c FROM nb GROUP BY 1), e AS (SELECT window_id, count(*) * 2 AS c FROM w8 GROUP BY 1)
  SELECT count(*) AS n_graphs, round(avg(n.c), 6) AS nodes_mean, max(n.c) AS nodes_max, round(avg(e.c), 6) AS edges_mean, max(e.c) AS edges_max FROM n JOIN e USING (window_id)""")
def _(spark, sf):
    nodes, edges = graph.build_graphs(clean(spark, sf), OPT, SEQ, ids=TIE)
    s = graph.graph_summary(nodes, edges)
    return s.withColumns({c: F.round(c, 6) for c in ["nodes_mean", "edges_mean"]})


@query("a07_class_counts", "WITH " + NODE_SQL + " SELECT 'node' AS kind, y, count(*) AS n FROM ny GROUP BY 2 UNION ALL SELECT 'edge', y, count(*) FROM w8 GROUP BY 2")
def _(spark, sf):
    nodes, edges = graph.build_graphs(clean(spark, sf), OPT, SEQ, ids=TIE)
    return graph.class_counts(nodes, edges)


@query("a07_class_weights", with_sql(CLEAN) + """, c AS (SELECT y, count(*) AS n FROM clean GROUP BY 1), w AS (SELECT y, n, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, greatest(n, 1))) AS raw FROM c)
  SELECT y, n, round(raw / sum(raw) OVER () * count(*) OVER (), 6) AS weight, round((sum(n) OVER ())::DOUBLE / (2 * CASE WHEN y = 0 THEN n ELSE (sum(CASE WHEN y > 0 THEN n END) OVER ()) END), 6) AS two_class_weight FROM w""")
def _(spark, sf):
    from flowloom.operators.metrics import class_weights
    w = class_weights(clean(spark, sf))
    return w.select("y", "n", r(F.col("weight"), "weight"), r(F.col("two_class_weight"), "two_class_weight"))


@query("g00_suspicious_hosts", "WITH " + NODE_SQL + " SELECT window_id, '10.0.0.' || host % 256 AS ip, round(dst_port_entropy, 6) AS dst_port_entropy, unique_dst_ports, unique_src_ips, round(answered_flows / greatest(out_degree, 1), 6) AS reciprocity FROM nb")
def _(spark, sf):
    """Which hosts look like scanners or flood victims, per window."""
    from flowloom.functions.addresses import int_to_ipv4
    w = hosts.keep_full_windows(windowed(spark, sf), 8)
    n = hosts.node_block(w).select(
        "window_id", int_to_ipv4(F.col("host")).alias("ip"), r(F.col("dst_port_entropy"), "dst_port_entropy"), "unique_dst_ports", "unique_src_ips",
        r(F.col("answered_flows") / F.greatest(F.col("out_degree"), F.lit(1)), "reciprocity"))
    return n.orderBy(F.desc("dst_port_entropy"), "window_id", "ip")
