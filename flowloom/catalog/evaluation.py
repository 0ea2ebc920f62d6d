"""Detector evaluation over scored flows of the driver tables."""

from pyspark.sql import functions as F

from flowloom.catalog.graphs import K, r
from flowloom.catalog.registry import query
from flowloom.catalog.tables import CLASSES, CLEAN, TIE, clean, scored, scored_sql, table, windowed, windowed_sql, with_sql
from flowloom.constants import ALERT_FLOW_COUNTS, FIXED_THRESHOLDS
from flowloom.functions import scoring
from flowloom.operators import audits, metrics

S = "WITH " + scored_sql()


def rated(spark, sf):
    p = F.col("probs")
    return scored(spark, sf).withColumns({"pred": scoring.argmax(p), "conf": scoring.confidence(p), "threat": scoring.threat(p)})


def rounded(df, **digits):
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CM = ",\ncm AS (SELECT y, pred, count(*) AS n FROM scored GROUP BY 1, 2)"
PC = CM + """,
pc AS (SELECT c AS class, coalesce((SELECT sum(n) FROM cm WHERE y = c), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM cm WHERE pred = c), 0)::BIGINT AS predicted,
  coalesce((SELECT sum(n) FROM cm WHERE y = c AND pred = c), 0)::BIGINT AS tp FROM (SELECT unnest([0,1,2,3,4,5]) AS c)),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM pc)"""


@query("a24_confusion", S + CM + " SELECT * FROM cm")
def _(spark, sf):
    return metrics.confusion(rated(spark, sf))


@query("a24_class_metrics", S + PC + " SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pm")
def _(spark, sf):
    return rounded(metrics.class_metrics(metrics.confusion(rated(spark, sf))))


@query("a24_summary", S + PC + """ SELECT round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(sum(f1) / 6, 6) AS macro_f1_all, count(*) FILTER (support > 0) AS classes_present,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS accuracy,
  (SELECT round(2 * count(*) FILTER (y > 0 AND pred > 0) / (count(*) FILTER (y > 0) + count(*) FILTER (pred > 0)), 6) FROM scored) AS binary_f1 FROM pm""")
def _(spark, sf):
    return rounded(metrics.summary_metrics(metrics.confusion(rated(spark, sf)), 6))


def curve_sql(src, score, pos, keys=""):
    part = f"PARTITION BY {keys}" if keys else ""
    sel = keys + ", " if keys else ""
    return f"""cs AS (SELECT {sel}{score} AS score, count(*) FILTER ({pos}) AS pos, count(*) FILTER (NOT ({pos})) AS neg FROM {src} GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N FROM cs)"""


AUCS = "sum(pos * (tp / (tp + fp))) / any_value(P) AS ap, sum(neg * (tp - pos + pos / 2)) / any_value(P) / any_value(N) AS auc"


@query("a25_binary_ap_auc", S + ", " + curve_sql("scored", "threat", "y > 0") + f" SELECT round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc FROM (SELECT {AUCS} FROM cv)")
def _(spark, sf):
    return rounded(metrics.curve_metrics(metrics.score_curve(rated(spark, sf), "threat", F.col("y") > 0)))


@query("a25_class_ap", S + ", long AS (" + " UNION ALL ".join(f"SELECT {k} AS class, p{k} AS s, y FROM scored" for k in range(6)) + "), " + curve_sql("long", "s", "y = class", "class") + f" SELECT class, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc FROM (SELECT class, {AUCS} FROM cv GROUP BY 1)")
def _(spark, sf):
    long = rated(spark, sf).select("y", F.posexplode("probs").alias("class", "s"))
    return rounded(metrics.curve_metrics(metrics.score_curve(long, "s", F.col("y") == F.col("class"), ["class"]), ["class"]))


@query("a26_recall_at_fpr", S + ", " + curve_sql("scored", "threat", "y > 0") + """ SELECT round(coalesce(max(tp) FILTER (fp <= greatest(floor(N * 0.01), 1)), 0) / any_value(P), 6) AS recall_at_1pct, round(coalesce(max(tp) FILTER (fp <= greatest(floor(N * 0.001), 1)), 0) / any_value(P), 6) AS recall_at_01pct FROM cv""")
def _(spark, sf):
    c = metrics.score_curve(rated(spark, sf), "threat", F.col("y") > 0)
    return rounded(metrics.curve_metrics(c, budgets={"recall_at_1pct": 0.01, "recall_at_01pct": 0.001}).select("recall_at_1pct", "recall_at_01pct"))


FPRT = """q AS (SELECT tg AS target, quantile_cont(threat, 1 - 0.95::DOUBLE) AS thr FROM scored, (SELECT 0.95::DOUBLE AS tg) WHERE y = 5 GROUP BY 1 UNION ALL SELECT 0.8::DOUBLE, quantile_cont(threat, 1 - 0.8::DOUBLE) FROM scored WHERE y = 5)"""


@query("a27_fpr_at_tpr", S + ", " + FPRT + " SELECT target, round(thr, 6) AS threshold, round(avg((threat >= thr)::INT), 6) AS fpr FROM scored, q WHERE y <> 5 GROUP BY target, thr")
def _(spark, sf):
    return rounded(metrics.fpr_at_tpr(rated(spark, sf), "threat", F.col("y") == 5, [0.95, 0.8]))


OS = """oc AS (SELECT threat AS score, count(*) FILTER (y <> 5 AND y = pred) AS rt, count(*) FILTER (y = 5) AS un FROM scored GROUP BY 1),
os AS (SELECT score, sum(rt) OVER (ORDER BY score) / (SELECT count(*) FROM scored WHERE y <> 5) AS ccr, sum(un) OVER (ORDER BY score) / (SELECT count(*) FROM scored WHERE y = 5) AS fpr FROM oc),
ol AS (SELECT *, coalesce(lag(ccr) OVER (ORDER BY score), 0) AS pc, coalesce(lag(fpr) OVER (ORDER BY score), 0) AS pf FROM os)"""


@query("a28_oscr_curve", S + ", " + OS + " SELECT round(score, 9) AS score, round(ccr, 6) AS ccr, round(fpr, 6) AS fpr FROM ol")
def _(spark, sf):
    s = rated(spark, sf)
    return rounded(metrics.oscr(s, "threat", F.col("y") == 5, F.col("y") == F.col("pred")).select("score", "ccr", "fpr"), score=9)


@query("a29_open_set_report", S + ", " + OS + ", " + FPRT + ", cl AS (SELECT * FROM scored WHERE y IN (0, 5)), " + curve_sql("cl", "threat", "y = 5") + f""", au AS (SELECT {AUCS} FROM cv)
  SELECT (SELECT round(sum((fpr - pf) * (ccr + pc) / 2), 6) FROM ol) AS oscr_auc,
  (SELECT round(avg((threat >= thr)::INT), 6) FROM scored, q WHERE y <> 5 AND target = 0.95::DOUBLE) AS fpr_at_95tpr, (SELECT round(avg((threat >= thr)::INT), 6) FROM scored, q WHERE y <> 5 AND target = 0.8::DOUBLE) AS fpr_at_80tpr,
  (SELECT round(avg((y = pred)::INT), 6) FROM scored WHERE y <> 5) AS known_accuracy, round(auc, 6) AS ood_auroc, round(ap, 6) AS ood_ap,
  (SELECT round(avg((threat >= thr)::INT), 6) FROM scored, q WHERE y = 0 AND target = 0.95::DOUBLE) AS fpr_at_95tpr_vs_benign FROM au""")
def _(spark, sf):
    return rounded(metrics.open_set_report(rated(spark, sf), "threat", 5))


GRID = f"""gr AS (SELECT DISTINCT g FROM (SELECT unnest(quantile_cont(threat, [{", ".join(f"{i}/20.0::DOUBLE" for i in range(21))}])) AS g FROM scored UNION ALL SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in FIXED_THRESHOLDS)}]))),
th AS (SELECT g AS threshold, count(*) FILTER (threat >= g AND y > 0) AS tp, count(*) FILTER (threat >= g AND y = 0) AS fp, count(*) FILTER (threat < g AND y > 0) AS fn, count(*) FILTER (threat < g AND y = 0) AS tn FROM scored, gr GROUP BY 1),
tt AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, 2 * tp / (2 * tp + fp + fn) AS f1 FROM th)"""


def pr_table(spark, sf):
    s = rated(spark, sf)
    grid = metrics.threshold_grid(s, "threat", points=21, fixed=FIXED_THRESHOLDS)
    return metrics.threshold_table(metrics.score_curve(s, "threat", F.col("y") > 0, grid=grid))


@query("a30_threshold_table", S + ", " + GRID + " SELECT round(threshold, 9) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM tt")
def _(spark, sf):
    return rounded(pr_table(spark, sf), threshold=9)


@query("a30_operating_points", S + ", " + GRID + """, o AS (SELECT 'max_f1' AS criterion, f1 AS b, * FROM tt UNION ALL SELECT 'fpr_le_0.01', recall, * FROM tt WHERE fpr <= 0.01 UNION ALL SELECT 'fpr_le_0.001', recall, * FROM tt WHERE fpr <= 0.001
  UNION ALL SELECT 'precision_ge_0.99', recall, * FROM tt WHERE precision >= 0.99 UNION ALL SELECT 'precision_ge_0.999', recall, * FROM tt WHERE precision >= 0.999)
  SELECT criterion, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY b DESC, threshold) = 1""")
def _(spark, sf):
    return rounded(metrics.operating_points(pr_table(spark, sf)))


@query("a31_class_gates", S + f""", gr AS (SELECT DISTINCT pred, g FROM (SELECT pred, unnest(quantile_cont(conf, [{", ".join(f"{i}/10.0::DOUBLE" for i in range(11))}])) AS g FROM scored WHERE pred > 0 GROUP BY 1)),
th AS (SELECT gr.pred AS class, g AS t, count(*) FILTER (conf >= g AND scored.pred = gr.pred AND y = gr.pred) AS tp, count(*) FILTER (conf >= g AND scored.pred = gr.pred AND y <> gr.pred) AS fp, count(*) FILTER (y = gr.pred) AS P FROM scored, gr GROUP BY 1, 2)
  SELECT class, round(t, 6) AS threshold, tp, fp, round(2 * tp / (tp + fp + P), 6) AS f1 FROM th QUALIFY row_number() OVER (PARTITION BY class ORDER BY 2 * tp / (tp + fp + P) DESC, t) = 1""")
def _(spark, sf):
    s = rated(spark, sf)
    hot = s.where("pred > 0").withColumn("class", F.col("pred"))
    grid = metrics.threshold_grid(hot, "conf", ["class"], points=11)
    curve = metrics.score_curve(hot, "conf", F.col("y") == F.col("class"), ["class"], grid)
    n = s.agg(F.count(F.lit(1)).alias("_n"))
    totals = s.where("y > 0").groupBy(F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("P")).crossJoin(n).withColumn("N", F.col("_n") - F.col("P")).drop("_n")
    best = metrics.operating_points(metrics.threshold_table(curve, ["class"], totals), ["class"]).where("criterion = 'max_f1'")
    t = metrics.threshold_table(curve, ["class"], totals).select("class", "threshold", "tp", "fp")
    return rounded(best.select("class", "threshold", "f1").join(t, ["class", "threshold"]))


@query("a32_threshold_for_precision", S + ", " + curve_sql("scored", "threat", "y > 0") + " SELECT round(min(score) FILTER (tp >= 0.6::DOUBLE * (tp + fp)), 9) AS threshold FROM cv")
def _(spark, sf):
    c = metrics.score_curve(rated(spark, sf), "threat", F.col("y") > 0)
    return rounded(metrics.threshold_for_precision(c, 0.6), threshold=9)


@query("a33_source_rows", S + " SELECT window_id, src_ip, round(max(threat), 6) AS score, bool_or(y > 0) AS attack FROM scored GROUP BY 1, 2")
def _(spark, sf):
    return rounded(metrics.source_rows(rated(spark, sf), "threat", ["window_id", "src_ip"]))


@query("a33_base_rates", S + ", s AS (SELECT bool_or(y > 0) AS a FROM scored GROUP BY window_id, src_ip) SELECT (SELECT count(*) FROM scored) AS n_flows, (SELECT round(avg((y > 0)::INT), 6) FROM scored) AS flow_rate, count(*) AS n_sources, round(avg(a::INT), 6) AS source_rate FROM s")
def _(spark, sf):
    return rounded(metrics.base_rates(rated(spark, sf), ["window_id", "src_ip"]))


@query("a34_confidence_quantiles", S + " SELECT y, pred, round(quantile_cont(conf, 0.1::DOUBLE), 6) AS q10, round(quantile_cont(conf, 0.5::DOUBLE), 6) AS q50, round(quantile_cont(conf, 0.9::DOUBLE), 6) AS q90, count(*) AS n, round(avg((conf >= 0.3)::INT), 6) AS share_at_floor FROM scored GROUP BY 1, 2")
def _(spark, sf):
    return rounded(metrics.confidence_quantiles(rated(spark, sf), [0.1, 0.5, 0.9], 0.3))


@query("a23_window_alerts", S + f""", w AS (SELECT window_id, count(*) FILTER (threat >= 0.95) AS hot, count(*) FILTER (y > 0 AND k1 % 3 = 0) > 20 AS atk FROM scored GROUP BY 1)
  SELECT k AS min_flows, count(*) AS windows, count(*) FILTER (atk2) AS attack_windows, count(*) FILTER (hot >= k) AS alerted, count(*) FILTER (hot >= k AND atk2) AS tp, count(*) FILTER (hot >= k AND NOT atk2) AS fp, count(*) FILTER (hot < k AND atk2) AS fn, count(*) FILTER (hot < k AND NOT atk2) AS tn
  FROM (SELECT w.hot, v.atk2 FROM w JOIN (SELECT window_id, count(*) FILTER (y > 0 AND window_id % 2 = 0) > 0 AS atk2 FROM scored GROUP BY 1) v USING (window_id)), (SELECT unnest({ALERT_FLOW_COUNTS}) AS k) GROUP BY 1""")
def _(spark, sf):
    s = rated(spark, sf).withColumn("y", F.when(F.col("window_id") % 2 == 0, F.col("y")).otherwise(0))
    return metrics.window_alerts(s, F.col("threat") >= 0.95, ALERT_FLOW_COUNTS).select("min_flows", "windows", "attack_windows", "alerted", "tp", "fp", "fn", "tn")


@query("a40_pooled_probabilities", S + " SELECT k1, round(avg(p0), 6) AS m0, round(avg(p5), 6) AS m5, count(*) AS submissions FROM scored GROUP BY 1")
def _(spark, sf):
    p = metrics.pooled_probabilities(rated(spark, sf), ["k1"], 6)
    return p.select("k1", r(F.col("probs")[0], "m0"), r(F.col("probs")[5], "m5"), "submissions")


DELTA = """fa AS (SELECT y AS class, avg((pred = y)::INT) AS v FROM scored WHERE k1 % 2 = 0 GROUP BY 1), fb AS (SELECT y AS class, avg((pred = y)::INT) AS v FROM scored WHERE k1 % 2 = 1 GROUP BY 1)"""


def recalls(s):
    return metrics.class_metrics(metrics.confusion(s))


@query("a41_metric_deltas", S + ", " + DELTA + " SELECT class, round(fa.v, 6) AS before, round(fb.v, 6) AS after, round(fb.v - fa.v, 6) AS delta, CASE WHEN fb.v - fa.v >= 0.05 THEN 'better' WHEN fb.v - fa.v <= -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM fa JOIN fb USING (class)")
def _(spark, sf):
    s = rated(spark, sf)
    return rounded(metrics.metric_deltas(recalls(s.where("k1 % 2 = 0")), recalls(s.where("k1 % 2 = 1")), ["class"], "recall"))


@query("a41_splits_agree", S + """, v AS (SELECT y AS class, k1 % 4 AS g, avg((pred = y)::INT) AS v FROM scored GROUP BY 1, 2), d AS (SELECT class, max(v) FILTER (g = 1) - max(v) FILTER (g = 0) AS a, max(v) FILTER (g = 3) - max(v) FILTER (g = 2) AS b FROM v GROUP BY 1)
  SELECT class, round(a, 6) AS delta_a, round(b, 6) AS delta_b, (CASE WHEN a > 0.02 THEN 1 WHEN a < -0.02 THEN -1 ELSE 0 END) = (CASE WHEN b > 0.02 THEN 1 WHEN b < -0.02 THEN -1 ELSE 0 END) AS agree FROM d""")
def _(spark, sf):
    s = rated(spark, sf)
    d = lambda i, j: metrics.metric_deltas(recalls(s.where(f"k1 % 4 = {i}")), recalls(s.where(f"k1 % 4 = {j}")), ["class"], "recall")
    return rounded(metrics.splits_agree(d(0, 1), d(2, 3), ["class"]))


@query("a42_scaler", with_sql(CLEAN) + " SELECT 'fwd_bytes' AS \"column\", round(avg(fwd_bytes), 3) AS mean, round(stddev_pop(fwd_bytes), 3) AS std FROM clean WHERE k1 % 3 = 0 UNION ALL SELECT 'fwd_packets', round(avg(fwd_packets), 3), round(stddev_pop(fwd_packets), 3) FROM clean WHERE k1 % 3 = 0")
def _(spark, sf):
    return rounded(audits.feature_moments(clean(spark, sf).where("k1 % 3 = 0"), ["fwd_bytes", "fwd_packets"]), mean=3, std=3)


@query("a42_standardise", with_sql(CLEAN) + f", m AS (SELECT avg(fwd_packets) AS a, stddev_pop(fwd_packets) AS s FROM clean WHERE k1 % 3 = 0) SELECT {K}, round((fwd_packets - a) / (s + 1e-6::DOUBLE), 6) AS fwd_packets FROM clean, m")
def _(spark, sf):
    c = clean(spark, sf)
    return rounded(audits.standardise(c, ["fwd_packets"], c.where("k1 % 3 = 0")).select(*TIE, "fwd_packets"))


@query("a43_mixed_windows", "WITH " + windowed_sql() + ", p AS (SELECT window_id, count(*) AS n, count(*) FILTER (y = 0) AS b FROM win GROUP BY 1) SELECT count(*) AS windows, count(*) FILTER (n >= 8 AND b > 0 AND b < n) AS mixed FROM p")
def _(spark, sf):
    return audits.mixed_windows(windowed(spark, sf))


@query("a44_prediction_changes", S + """, z AS (SELECT y, pred, p0, p1, p2, p3, p4, p5, CASE WHEN p1 >= greatest(p2, p3, p4, p5) THEN 1 WHEN p2 >= greatest(p3, p4, p5) THEN 2 WHEN p3 >= greatest(p4, p5) THEN 3 WHEN p4 >= p5 THEN 4 ELSE 5 END AS pb FROM scored)
  SELECT y, count(*) AS n, count(*) FILTER (pred <> pb) AS changed, round(max(p0), 6) AS max_delta, round(avg((pred = y)::INT), 6) AS recall_before, round(avg((pb = y)::INT), 6) AS recall_after FROM z GROUP BY 1""")
def _(spark, sf):
    s = rated(spark, sf)
    q = F.transform("probs", lambda p, i: F.when(i == 0, 0.0).otherwise(p))
    other = s.select(*TIE, "t", q.alias("probs")).withColumn("pred", scoring.argmax(F.col("probs")))
    return rounded(metrics.prediction_changes(s, other, [*TIE, "t"]))


BURST = """lb AS (SELECT source_file, label, sum(nw) AS bursts, count(*) AS n_rows FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source_file, label ORDER BY t) > 172800 OR lag(t) OVER (PARTITION BY source_file, label ORDER BY t) IS NULL THEN 1 ELSE 0 END AS nw FROM clean) GROUP BY 1, 2)"""


@query("a45_label_bursts", with_sql(CLEAN, BURST) + " SELECT source_file, label, n_rows, bursts::BIGINT AS bursts FROM lb")
def _(spark, sf):
    return audits.label_bursts(clean(spark, sf), ["source_file", "label"], 172800)


@query("a45_taxonomy_audit", with_sql(CLEAN, BURST) + """, n AS (SELECT unnest(['cicids6', 'grouped', 'flood4']) AS taxonomy), j AS (SELECT taxonomy, label, n_rows, bursts, CASE WHEN label IN ('BENIGN', 'PortScan') THEN label WHEN label = 'DDoS' THEN CASE taxonomy WHEN 'flood4' THEN 'Volumetric_Flood' ELSE 'DDoS' END END AS class FROM lb, n)
  SELECT taxonomy, class, CASE WHEN class IS NULL THEN label END AS dropped_label, sum(n_rows)::BIGINT AS n_rows, sum(bursts)::BIGINT AS bursts FROM j GROUP BY 1, 2, 3""")
def _(spark, sf):
    from flowloom.operators.cleaning import taxonomy_table
    b = audits.label_bursts(clean(spark, sf), ["source_file", "label"], 172800)
    return audits.taxonomy_audit(b, taxonomy_table(spark))


@query("a45_missing_categories", with_sql(CLEAN) + " SELECT x AS label FROM (SELECT unnest(['BENIGN', 'Botnet', 'Infiltration', 'Heartbleed']) AS x) WHERE x NOT IN (SELECT label FROM clean)")
def _(spark, sf):
    return audits.missing_categories(clean(spark, sf), ["BENIGN", "Botnet", "Infiltration", "Heartbleed"])


@query("a46_topology_audit", with_sql(CLEAN) + """, c AS (SELECT label, src_ip, count(*) AS n FROM clean GROUP BY 1, 2)
  SELECT label, count(*) AS n_flows, count(DISTINCT src_ip) AS n_src, count(DISTINCT dst_ip) AS n_dst, count(DISTINCT dst_port) AS n_ports, (SELECT src_ip FROM c WHERE c.label = clean.label ORDER BY n DESC, src_ip LIMIT 1) AS top_source FROM clean GROUP BY label""")
def _(spark, sf):
    return audits.topology_audit(clean(spark, sf))


CB = "cb AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(conf) AS mean_conf, avg((y = pred)::INT) AS accuracy FROM scored GROUP BY 1)"


@query("a47_calibration_bins", S + ", " + CB + " SELECT bin, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy FROM cb")
def _(spark, sf):
    return rounded(metrics.calibration_bins(rated(spark, sf)))


@query("a47_calibration_error", S + ", " + CB + " SELECT round(sum(n * abs(mean_conf - accuracy)) / sum(n), 6) AS ece FROM cb")
def _(spark, sf):
    return rounded(metrics.calibration_error(metrics.calibration_bins(rated(spark, sf))))


@query("a48_never_predicted", S + " SELECT y AS class, count(*) AS n_true, 0::BIGINT AS n_pred FROM scored WHERE y IN (2, 4) GROUP BY 1")
def _(spark, sf):
    s = rated(spark, sf).withColumn("pred", F.when(F.col("pred").isin(2, 4), 0).otherwise(F.col("pred")))
    return metrics.never_predicted(metrics.confusion(s))


COR = ["fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "duration_us", "bytes_per_s", "packets_per_s"]


@query("a49_correlations", with_sql(CLEAN) + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM clean" for i, a in enumerate(COR) for b in COR[i + 1:]))
def _(spark, sf):
    return rounded(audits.correlations(clean(spark, sf), COR))


@query("a49_histogram", with_sql(CLEAN) + ", c AS (SELECT quantile_cont(fwd_bytes, 0.99::DOUBLE) AS cap FROM clean) SELECT least(floor(fwd_bytes / cap * 50), 49)::INT AS bin, count(*) AS n FROM clean, c WHERE fwd_bytes <= cap GROUP BY 1")
def _(spark, sf):
    return audits.capped_histogram(clean(spark, sf), "fwd_bytes")


@query("a49_top_ports", with_sql(CLEAN) + " SELECT dst_port AS value, count(*) AS n FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return audits.top_values(clean(spark, sf), "dst_port")


@query("a49_class_counts", with_sql(CLEAN) + " SELECT label AS value, count(*) AS n FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return audits.top_values(clean(spark, sf), "label")


def box_sql(src, keys, cols, floor=1):
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS \"column\", count(*) AS n, round(min({c}), 5)::DOUBLE AS low, round(quantile_cont({c}::DOUBLE, 0.25::DOUBLE), 5) AS q1, round(quantile_cont({c}::DOUBLE, 0.5::DOUBLE), 5) AS median, round(quantile_cont({c}::DOUBLE, 0.75::DOUBLE), 5) AS q3, round(max({c}), 5)::DOUBLE AS high FROM {src} GROUP BY {keys} HAVING count(*) >= {floor}" for c in cols)


@query("a49_box_statistics", with_sql(CLEAN) + " " + box_sql("clean", "label", ["fwd_bytes", "packets_per_s"]))
def _(spark, sf):
    b = audits.box_statistics(clean(spark, sf), ["label"], ["fwd_bytes", "packets_per_s"])
    return rounded(b, low=5, q1=5, median=5, q3=5, high=5)


def _node_sql():
    from flowloom.catalog.graphs import NODE_SQL
    return NODE_SQL


@query("a50_node_distribution", "WITH " + _node_sql() + ", nn AS (SELECT ny.y, ln(1 + out_degree) AS log_out_degree, dst_port_entropy FROM nb JOIN ny ON nb.window_id = ny.window_id AND nb.host = ny.host) " + box_sql("nn", "y", ["log_out_degree", "dst_port_entropy"], 3))
def _(spark, sf):
    from flowloom.operators import hosts
    from flowloom.plans import graph
    n = graph.build_nodes(hosts.keep_full_windows(windowed(spark, sf), 8))
    return rounded(audits.box_statistics(n, ["y"], ["log_out_degree", "dst_port_entropy"], 3), low=5, q1=5, median=5, q3=5, high=5)


@query("a51_claim_check", with_sql(CLEAN) + ", c AS (SELECT label, count(*) AS computed FROM clean WHERE label <> 'DDoS' GROUP BY 1) SELECT label, computed::DOUBLE AS computed, expected::DOUBLE AS expected, CASE WHEN computed IS NULL THEN 'NO DATA' WHEN expected IS NULL OR computed <> expected THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c FULL JOIN (SELECT label, count(*) + (label = 'Botnet')::INT AS expected FROM clean WHERE label <> 'DoSHulk' GROUP BY 1) USING (label)")
def _(spark, sf):
    c = clean(spark, sf)
    got = c.where("label <> 'DDoS'").groupBy("label").agg(F.count(F.lit(1)).alias("computed"))
    want = c.where("label <> 'DoSHulk'").groupBy("label").agg((F.count(F.lit(1)) + F.max(F.when(F.col("label") == "Botnet", 1).otherwise(0))).alias("expected"))
    return audits.claim_check(got, want, ["label"]).withColumns({c: F.col(c).cast("double") for c in ["computed", "expected"]})


RANKS = """rk AS (SELECT *, (rank() OVER (ORDER BY threat) - 1) / greatest(count(*) OVER () - 1, 1) AS rt, (rank() OVER (ORDER BY fwd_bytes) - 1) / greatest(count(*) OVER () - 1, 1) AS rd FROM scored)"""


@query("w09_combined_scores", S + ", " + RANKS + f" SELECT {K}, round(CASE WHEN pred <> 0 THEN 0.5 + 0.5 * rt ELSE 0.5 * rd END, 6) AS cascade, round(CASE WHEN pred <> 0 THEN rt ELSE 0.5 * rt + 0.5 * rd END, 6) AS blended FROM rk")
def _(spark, sf):
    return rounded(metrics.combined_scores(rated(spark, sf), "threat", "fwd_bytes").select(*TIE, "cascade", "blended"))


@query("g10_class_offsets")
def _(spark, sf):
    """Offsets fitted on one half and what they do to each class on the other."""
    from flowloom.operators.sampling import stratified_halves
    s = stratified_halves(rated(spark, sf).select(*TIE, "y", "probs"), "y", TIE, 0.4)
    from flowloom.workspace import materialize
    s = materialize(s.select("y", "probs", "part"), "halves", ["part"])
    offsets = metrics.fit_class_offsets(s, 6)
    check = s.where("part = 'check'").withColumn("pred", scoring.adjusted_argmax(F.col("probs"), F.array(*[F.lit(x) for x in offsets])))
    return metrics.class_metrics(metrics.confusion(check)).withColumn("offset", F.get(F.array(*[F.lit(x) for x in offsets]), F.col("class")))
