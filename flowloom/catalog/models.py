"""Model-side jobs over the driver tables: neighbours, forests, variants, open-set scores."""

from pyspark.sql import functions as F

from flowloom.catalog.evaluation import rated, rounded
from flowloom.catalog.expressions import live_extra
from flowloom.catalog.graphs import K, NODE_SQL, OPT, r
from flowloom.catalog.registry import query
from flowloom.catalog.tables import CLEAN, FLOWS, LIVE, SEQ, TIE, WEEK, clean, flows, live, scored_sql, table, windowed, windowed_sql, with_sql
from flowloom.constants import EDGE_FEATURES, NODE_FEATURES
from flowloom.operators import hosts, metrics, openset, rules, studies
from flowloom.plans import graph, tabular
from flowloom.settings import WindowOptions
from flowloom.workspace import materialize

FORWARD = WindowOptions(seconds=WEEK, add_reverse_edges=False)


@query("g02_chained_history", "WITH " + windowed_sql() + """, pt AS (SELECT *, CASE WHEN source_file <= '1998' THEN 0 WHEN source_file <= '1999' THEN 1 ELSE 2 END AS part FROM clean),
  pw AS (SELECT *, (t - min(t) OVER (PARTITION BY part)) // 604800 AS wid FROM pt), hv AS (SELECT part, wid, host, count(*) AS n FROM (SELECT part, wid, src_ip AS host FROM pw UNION ALL SELECT part, wid, dst_ip FROM pw) GROUP BY 1, 2, 3)
  SELECT part, wid AS window_id, host AS ip, count(*) OVER (PARTITION BY host ORDER BY part, wid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS windows_before FROM hv""")
def _(spark, sf):
    c = clean(spark, sf).withColumn("part", F.when(F.col("source_file") <= "1998", 0).when(F.col("source_file") <= "1999", 1).otherwise(2))
    opt = WindowOptions(seconds=WEEK, min_edges=1)
    nodes, _ = graph.build_graphs(c, opt, SEQ, ids=TIE, by=["part"], history=["part", "window_id"])
    return nodes.select("part", "window_id", "ip", F.round(F.expm1("log_windows_seen")).cast("bigint").alias("windows_before"))


@query("g03_neighbour_mean", "WITH " + NODE_SQL + """, p AS (SELECT window_id, src, dst, count(*) AS w FROM w8 GROUP BY 1, 2, 3), h0 AS (SELECT window_id, host, ln(1 + out_degree) AS a, dst_port_entropy AS b FROM nb),
  h1 AS (SELECT h0.window_id, h0.host, coalesce((SELECT sum(s.a * w) / sum(w) FROM p JOIN h0 s ON s.window_id = p.window_id AND s.host = p.src WHERE p.window_id = h0.window_id AND p.dst = h0.host), 0) AS a, coalesce((SELECT sum(s.b * w) / sum(w) FROM p JOIN h0 s ON s.window_id = p.window_id AND s.host = p.src WHERE p.window_id = h0.window_id AND p.dst = h0.host), 0) AS b FROM h0)
  SELECT h1.window_id, h1.host, round(coalesce((SELECT sum(s.a * w) / sum(w) FROM p JOIN h1 s ON s.window_id = p.window_id AND s.host = p.src WHERE p.window_id = h1.window_id AND p.dst = h1.host), 0), 5) AS log_out_degree, round(coalesce((SELECT sum(s.b * w) / sum(w) FROM p JOIN h1 s ON s.window_id = p.window_id AND s.host = p.src WHERE p.window_id = h1.window_id AND p.dst = h1.host), 0), 5) AS dst_port_entropy FROM h1""")
def _(spark, sf):
    nodes, edges = graph.build_graphs(clean(spark, sf), FORWARD, SEQ, ids=TIE)
    nodes = materialize(nodes.select("window_id", "host", "log_out_degree", "dst_port_entropy"), "nodes")
    m = tabular.neighbour_mean(nodes, edges, ["log_out_degree", "dst_port_entropy"], 2)
    return m.select("window_id", "host", r(F.col("log_out_degree"), "log_out_degree", 5), r(F.col("dst_port_entropy"), "dst_port_entropy", 5))


def tabular_rows(spark, sf):
    nodes, edges = graph.build_graphs(clean(spark, sf), FORWARD, SEQ, ids=TIE)
    rows = rules.tabular_rows(edges, nodes, EDGE_FEATURES, NODE_FEATURES, ids=TIE)
    names = [*EDGE_FEATURES, *[f"src_{f}" for f in NODE_FEATURES], *[f"dst_{f}" for f in NODE_FEATURES]]
    return materialize(rows, "tabular"), names


@query("g04_forest_baseline")
def _(spark, sf):
    rows, names = tabular_rows(spark, sf)
    late = F.col("window_id") >= 250
    model = tabular.fit_forest(rows.where(~late), names, trees=8, depth=5)
    cm = metrics.confusion(tabular.forest_scores(model, rows.where(late), names))
    return metrics.class_metrics(cm)


@query("g04_importances")
def _(spark, sf):
    rows, names = tabular_rows(spark, sf)
    return tabular.importances(tabular.fit_forest(rows, names, trees=5, depth=4), names, spark)


FG = f"fg AS (SELECT *, row_number() OVER (ORDER BY t, {K}) - 1 AS position, (row_number() OVER (ORDER BY t, {K}) - 1) // 500 AS batch FROM live)"


@query("w05_previous_edges", with_sql(LIVE, FG) + """, l AS (SELECT batch, position, lag(position) OVER (PARTITION BY batch ORDER BY position) AS c, lag(position) OVER (PARTITION BY batch, dst_port ORDER BY position) AS p FROM fg)
  SELECT batch, c AS src, position AS dst, 'previous' AS kind FROM l WHERE c IS NOT NULL UNION ALL SELECT batch, p, position, 'same_port' FROM l WHERE p IS NOT NULL AND p <> c""")
def _(spark, sf):
    from flowloom.operators.sampling import row_windows
    b = row_windows(live(spark, sf), [F.col("t"), *[F.col(c) for c in TIE]], 500)
    return tabular.previous_edges(b, once=True)


@query("g05_flow_graph_nodes", with_sql(LIVE, FG) + f""", v AS (SELECT *, dst_port / 65535.0::DOUBLE AS pn, byte_count / (packet_count + 1e-6::DOUBLE) AS ps FROM fg), m AS (SELECT avg(pn) AS a, stddev_pop(pn) AS s, avg(ps) AS a2, stddev_pop(ps) AS s2 FROM v)
  SELECT {K}, batch, position, round((pn - a) / (s + 1e-6::DOUBLE), 5) AS x_port_norm, round((ps - a2) / (s2 + 1e-6::DOUBLE), 5) AS x_avg_packet_size FROM v, m""")
def _(spark, sf):
    nodes, _ = tabular.flow_graphs(live_extra(spark, sf), [F.col("t"), *[F.col(c) for c in TIE]])
    return rounded(nodes.select(*TIE, "batch", "position", "x_port_norm", "x_avg_packet_size"), x_port_norm=5, x_avg_packet_size=5)


@query("g05_flow_graph_edges", with_sql(LIVE, FG) + """, l AS (SELECT batch, position, lag(position) OVER (PARTITION BY batch ORDER BY position) AS c, lag(position) OVER (PARTITION BY batch, dst_port ORDER BY position) AS p FROM fg)
  SELECT batch, kind, count(*) AS n FROM (SELECT batch, 'previous' AS kind FROM l WHERE c IS NOT NULL UNION ALL SELECT batch, 'same_port' FROM l WHERE p IS NOT NULL) GROUP BY 1, 2""")
def _(spark, sf):
    _, edges = tabular.flow_graphs(live_extra(spark, sf), [F.col("t"), *[F.col(c) for c in TIE]])
    return edges.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- variants
@query("g06_shuffled_values", "WITH " + windowed_sql() + " SELECT round(sum(fwd_bytes), 2) AS total, count(DISTINCT k1) AS ids, count(*) AS n, true AS moved FROM win")
def _(spark, sf):
    w = windowed(spark, sf).select(*TIE, "window_id", "fwd_bytes")
    ids = ["k1", "k2", "k3", "k4", "window_id"]
    s = studies.shuffle_columns(w.withColumn("k", F.col("k5")), ["fwd_bytes"], [*TIE, "window_id"], 1)
    moved = F.count_if(F.col("fwd_bytes") != F.col("k5")) > 0.9 * F.count(F.lit(1))
    return s.agg(r(F.sum("fwd_bytes"), "total", 2), F.count_distinct("k1").alias("ids"), F.count(F.lit(1)).alias("n"), moved.alias("moved"))


@query("g06_rewired", "WITH " + windowed_sql() + " SELECT window_id, count(*) AS n, true AS inside FROM win GROUP BY 1")
def _(spark, sf):
    w = windowed(spark, sf).select(*TIE, "window_id", "src", "dst")
    out = studies.rewired(w, TIE)
    hosts_of = w.select("window_id", F.explode(F.array("src", "dst")).alias("src")).distinct().withColumn("ok", F.lit(True))
    return out.join(hosts_of, ["window_id", "src"], "left").groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("inside"))


@query("g06_permuted_hosts", "WITH " + windowed_sql() + " SELECT window_id, count(*) AS n, count(*) AS n_ips FROM (SELECT window_id, src AS h FROM win UNION SELECT window_id, dst FROM win) GROUP BY 1")
def _(spark, sf):
    from flowloom.functions.addresses import int_to_ipv4
    n = windowed(spark, sf).select("window_id", F.explode(F.array("src", "dst")).alias("host")).distinct()
    p = studies.permuted_hosts(n.withColumn("ip", int_to_ipv4(F.col("host"))), 3)
    return p.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("n_ips"))


@query("g06_zeroed_features", "WITH " + windowed_sql() + " SELECT count(*) AS n, 0.0::DOUBLE AS volume, 0.0::DOUBLE AS one_out, 0::BIGINT AS tokens, true AS rest FROM win")
def _(spark, sf):
    from flowloom.constants import VOLUMETRIC_FEATURES
    _, e = graph.build_graphs(clean(spark, sf), FORWARD, SEQ, ids=TIE)
    z = studies.without_tokens(studies.leave_one_out(studies.without_edge_features(e, VOLUMETRIC_FEATURES), "log_total_bytes"))
    return z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("log_bytes_per_s") + F.col("log_packets_per_s")).alias("volume"), F.sum("log_total_bytes").alias("one_out"),
                 F.sum(F.col("dst_token") + F.col("src_token") + F.col("protocol_token")).alias("tokens"), (F.sum("log_total_packets") > 0).alias("rest"))


@query("g07_degraded_flows", with_sql(CLEAN) + f" SELECT {K}, fwd_packets + bwd_packets AS fwd_packets, round(fwd_bytes + bwd_bytes, 4) AS fwd_bytes, 0.0::DOUBLE AS bwd_bytes, 0.0::DOUBLE AS syn FROM clean")
def _(spark, sf):
    return rounded(studies.degrade_flows(clean(spark, sf)).select(*TIE, "fwd_packets", "fwd_bytes", "bwd_bytes", "syn"), fwd_bytes=4)


@query("g07_degraded_edges", "WITH " + windowed_sql() + " SELECT count(*) AS n, count(*)::DOUBLE AS ones, 0.0::DOUBLE AS zeros FROM win")
def _(spark, sf):
    _, e = graph.build_graphs(clean(spark, sf), FORWARD, SEQ, ids=TIE)
    d = studies.degrade_edges(e)
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("fwd_packet_ratio").alias("ones"), F.sum(F.col("syn_ratio") + F.col("iat_burstiness")).alias("zeros"))


@query("g08_recount_polls", with_sql(CLEAN) + f""", d AS (SELECT *, k2 * 4.0::DOUBLE AS dur, t // 5 * 5 + 5 AS tick FROM clean), p AS (SELECT *, unnest(range(0, greatest(CAST(floor((t + dur + 3 - tick) / 5) AS BIGINT) + 1, 1))) AS poll FROM d),
  q AS (SELECT *, tick + poll * 5 AS obs, least(greatest(tick + poll * 5 - t, 1e-3::DOUBLE), dur + 3) AS since FROM p)
  SELECT {K}, poll, obs AS t, round(fwd_bytes * least(least(since, dur) / dur, 1), 6) AS fwd_bytes, round(bytes_per_s * (least(since, dur) / since), 6) AS bytes_per_s, since * 1e6 AS duration_us FROM q""")
def _(spark, sf):
    c = clean(spark, sf).withColumn("duration_us", F.col("k2") * 4e6)
    out = studies.recount_polls(c, 5, 3.0)
    return rounded(out.select(*TIE, "poll", "t", "fwd_bytes", "bytes_per_s", "duration_us"), fwd_bytes=6, bytes_per_s=6)


def toy_probabilities(rows):
    """Six class probabilities from volume, direction and rate."""
    x = F.log1p("fwd_bytes") + 2 * F.col("bwd_packets") / (F.col("fwd_packets") + F.col("bwd_packets") + 1) + F.log1p("bytes_per_s") * 0.1
    w = [F.exp(-F.abs(x - (7.0 + k))) + 1e-9 for k in range(6)]
    rows = rows.withColumn("_w", F.array(*w))
    rows = rows.withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("probs", F.transform("_w", lambda v: v / F.col("_s")))


@query("g09_cost_study")
def _(spark, sf):
    c = clean(spark, sf).select(*TIE, "t", "y", "duration_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "bytes_per_s", "packets_per_s", "syn")
    return studies.cost_study(c, toy_probabilities, TIE, 6)


# ------------------------------------------------------------------- open set
def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("g11_random_projection", "SELECT vec_id, 8 AS dim, true AS shorter FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf)
    mean = openset.vector_mean(v, "x", 64)
    p = openset.project(v, "x", mean, openset.random_basis(64, 8))
    length = lambda c: F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), lambda s, a: s + a)
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    return p.select("vec_id", F.size("z").alias("dim"), (length("z") <= length(centred) + 1e-9).alias("shorter"))


@query("g11_pca_projection")
def _(spark, sf):
    v = vectors(spark, sf)
    z = openset.project(v, "x", openset.vector_mean(v, "x", 64), openset.pca_basis(v, "x", 4))
    return z.agg(*[r(F.var_pop(F.get("z", F.lit(i))), f"var{i}") for i in range(4)])


def mixture(spark, sf):
    v = vectors(spark, sf)
    z = materialize(openset.project(v, "x", openset.vector_mean(v, "x", 64), openset.random_basis(64, 8)).select("vec_id", "label", "z"), "projected")
    return z, openset.fit_mixture(z.where("label < 8"), "z", "label", 8, k=2)


def lloyd_sql(rounds):
    """Two clusters of every class of the vectors ``v`` (label, x): from the class mean, one standard
    deviation to both sides of its widest axis, then the rounds."""
    near = "SELECT v.vec_id, label, v.x, first(j ORDER BY list_distance(v.x, c), j) AS j FROM v JOIN {} USING (label) GROUP BY ALL"
    steps = [f"""a{k} AS MATERIALIZED ({near.format(f"c{k}")}),
c{k + 1} AS MATERIALIZED (SELECT label, j, list(m ORDER BY i) AS c FROM (SELECT label, j, i, avg(x[i]) AS m FROM a{k}, axis GROUP BY ALL) GROUP BY ALL)""" for k in range(rounds)]
    return f"""axis AS (SELECT unnest(range(1, 65)) AS i),
dims AS (SELECT label, i, avg(x[i]) AS m, var_pop(x[i]) AS s FROM v, axis GROUP BY ALL),
wide AS (SELECT label, first(i ORDER BY s DESC, i) AS a, sqrt(max(s)) AS w FROM dims GROUP BY 1),
c0 AS (SELECT label, j, list(m + CASE WHEN i = a THEN (2 * j - 1) * w ELSE 0 END ORDER BY i) AS c FROM dims JOIN wide USING (label), (SELECT unnest([0, 1]) AS j) GROUP BY ALL),
{", ".join(steps)}, placed AS MATERIALIZED ({near.format(f"c{rounds}")})"""


@query("g12_mixture_means", with_sql("v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label < 8)", lloyd_sql(20), """size AS (SELECT label, j, count(*) AS n FROM placed GROUP BY ALL),
mom AS (SELECT label, j, i, avg(x[i]) AS m, var_pop(x[i]) AS s FROM placed, axis GROUP BY ALL),
total AS (SELECT label, j, sum(m) AS mean_sum, sqrt(sum(m * m)) AS mean_length, sum(s) AS trace FROM mom GROUP BY ALL)""") + """ SELECT label, j AS "cluster", n, n >= 20 AS fitted, CASE WHEN n >= 20 THEN round(n / (SELECT count(*) FROM v), 6) END AS weight, CASE WHEN n >= 20 THEN round(mean_sum, 5) END AS mean_sum, CASE WHEN n >= 20 THEN round(mean_length, 5) END AS mean_length, CASE WHEN n >= 20 THEN round(trace, 4) END AS trace FROM size JOIN total USING (label, j)""")
def _(spark, sf):
    """Two clusters in every class of the 64-dimensional vectors, and those with too few vectors."""
    import numpy as np

    fit = openset.fit_class_mixture(vectors(spark, sf).where("label < 8"), "x", "label", 64, k=2)
    rows = [(c["label"], c["cluster"], c["n"], True, c["weight"], float(sum(c["mean"])), float(np.linalg.norm(c["mean"])), float(np.trace(c["cov"]) - 64e-6)) for c in fit.components]
    rows += [(c["label"], c["cluster"], c["n"], False, None, None, None, None) for c in fit.skipped]
    out = spark.createDataFrame(rows, "label int, cluster int, n bigint, fitted boolean, weight double, mean_sum double, mean_length double, trace double")
    return rounded(out, weight=6, mean_sum=5, mean_length=5, trace=4)


@query("g13_distances")
def _(spark, sf):
    z, components = mixture(spark, sf)
    d = openset.mahalanobis(z, "z", components)
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("distance"), "mean_distance", 4), F.bool_and(F.abs(F.array_min("per_class") - F.col("distance")) < 1e-9).alias("consistent"))


@query("g14_acceptance_threshold")
def _(spark, sf):
    z, components = mixture(spark, sf)
    return openset.acceptance_threshold(openset.mahalanobis(z.where("label < 8"), "z", components))


@query("g15_open_set_scores")
def _(spark, sf):
    """Cascade and blended scores of known against unknown vectors."""
    z, components = mixture(spark, sf)
    d = openset.mahalanobis(z, "z", components).withColumns({
        "pred": (F.array_position("per_class", F.array_min("per_class")) - 1).cast("int"), "y": F.col("label"),
        "threat": 1.0 / (1.0 + F.get("per_class", F.lit(0)))})
    both = metrics.combined_scores(materialize(d, "distances"), "threat", "distance")
    return metrics.open_set_report(both.withColumn("y", F.when(F.col("y") >= 8, 99).otherwise(F.col("y"))), "blended", 99)


@query("r10_gated_update")
def _(spark, sf):
    """Three micro-batches of vectors; each component follows those it takes in."""
    from flowloom.streaming.mixture import Following, state_rows
    from flowloom.streaming.stepped import SteppedState
    from flowloom.workspace import new_path

    z, components = mixture(spark, sf)
    top = openset.acceptance_threshold(openset.mahalanobis(z.where("label < 8"), "z", components)).first()[0]
    source = new_path(spark, "vectors")
    rows = z.select("vec_id", "z", (F.col("vec_id") % 3).alias("window_id"))
    for window in range(3):
        rows.where(F.col("window_id") == window).coalesce(1).write.mode("append").parquet(source)
    following = Following(top, resync_every=2)
    steps = SteppedState(spark, new_path(spark, "mixture-states"), state_rows(spark, components), following.step)
    steps.run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source))
    trace = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda a, i: a + F.element_at("cov", i * 9 + 1))
    return steps.reports().select(
        F.col("window").cast("bigint").alias("step"), "component", "label", "accepted", "rejected", "n_updates", "steps",
        r(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), "mean_sum"), r(trace, "trace"))


@query("g16_negative_pairs")
def _(spark, sf):
    n = openset.negative_pairs(windowed(spark, sf).select(*TIE, "window_id", "src", "dst"), TIE)
    return n.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("src") != F.col("dst")).alias("distinct_ends"))
