"""Split protocols, ranks, sampling and split audits over the driver tables."""

from pyspark.sql import functions as F

from flowloom.catalog.graphs import K, r
from flowloom.catalog.registry import query
from flowloom.catalog.tables import CLEAN, TIE, WEEK, clean, windowed, windowed_sql, with_sql
from flowloom.operators import audits, ordered, sampling, splits
from flowloom.settings import SplitOptions

DAY = 86400
OPT = SplitOptions(gap_seconds=5 * DAY, episode_gap_seconds=DAY)
FEW = SplitOptions(gap_seconds=5 * DAY, episode_gap_seconds=3 * DAY)


def rare(spark, sf):
    """Attacks moved into one week of every 13, each class into its own, so that classes have bursts."""
    week = F.floor(F.col("t") / WEEK) % 13
    return clean(spark, sf).withColumn("t", F.when(F.col("y") == 0, F.col("t")).otherwise(F.col("t") + (F.col("y") * 2 - week) * WEEK))


RARE = CLEAN + f",\nrare AS (SELECT * REPLACE (CASE WHEN y = 0 THEN t ELSE t + (y * 2 - t // {WEEK} % 13) * {WEEK} END AS t) FROM clean)"


def rank_sql(src, by, gap):
    """Row-by-row form of the rank cut with its shrinking dead zone."""
    part = f"PARTITION BY {by}" if by else ""
    sel = by if by else "1 AS one"
    key = by if by else "one"
    return f"""rk AS (SELECT *, {'' if by else '1 AS one,'} row_number() OVER ({part} ORDER BY t, {K}) - 1 AS pos, count(*) OVER ({part}) AS n FROM {src}),
pa AS (SELECT {key}, any_value(n) AS n, least(greatest(CAST(floor(any_value(n) * 0.7::DOUBLE) AS BIGINT), 1), any_value(n) - 2) AS ia, min(t) AS lo, max(t) AS hi FROM rk GROUP BY 1),
pb AS (SELECT *, least(greatest(CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT), ia + 1), n - 1) AS ib,
  least({gap}, CAST(floor(greatest((hi - lo) * 0.05::DOUBLE, 1)) AS BIGINT)) AS g FROM pa),
pc AS (SELECT pb.*, (SELECT t FROM rk WHERE rk.{key} = pb.{key} AND pos = ia) AS ta, (SELECT t FROM rk WHERE rk.{key} = pb.{key} AND pos = ib) AS tb FROM pb),
pd AS (SELECT pc.{key}, any_value(pc.n) n, any_value(ia) ia, any_value(ib) ib, any_value(ta) ta, any_value(tb) tb, any_value(g) g,
  least(count(*) FILTER (t < ta - g), count(*) FILTER (t > ta + g AND t < tb - g), count(*) FILTER (t > tb + g)) AS f1,
  least(count(*) FILTER (t < ta - g // 2), count(*) FILTER (t > ta + g // 2 AND t < tb - g // 2), count(*) FILTER (t > tb + g // 2)) AS f2
  FROM rk JOIN pc ON rk.{key} = pc.{key} GROUP BY 1),
pl AS (SELECT *, CASE WHEN f1 >= greatest(floor(n * 0.02), 1) THEN g WHEN g // 2 > 0 AND f2 >= greatest(floor(n * 0.02), 1) THEN g // 2 ELSE 0 END AS z FROM pd),
rs AS (SELECT rk.* EXCLUDE (n), CASE WHEN z = 0 THEN CASE WHEN pos < ia THEN 'train' WHEN pos < ib THEN 'val' ELSE 'test' END
  ELSE CASE WHEN t < ta - z THEN 'train' WHEN t > ta + z AND t < tb - z THEN 'val' WHEN t > tb + z THEN 'test' END END AS split FROM rk JOIN pl ON rk.{key} = pl.{key})"""


EP = f"""ep AS (SELECT *, sum(nw) OVER (PARTITION BY label ORDER BY t, {K} ROWS UNBOUNDED PRECEDING) AS episode FROM
  (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY label ORDER BY t, {K}) > {3 * DAY} THEN 1 ELSE 0 END AS nw FROM rare WHERE label <> 'BENIGN'))"""
EPISODE = rank_sql("rare", "label", 5 * DAY) + ",\n" + EP + f""",
ec AS (SELECT label, max(episode) + 1 AS ne, count(*) AS n FROM ep GROUP BY 1),
ee AS (SELECT ep.*, CASE WHEN episode < greatest(floor(ne * 0.7::DOUBLE), 1) THEN 'train' WHEN episode < greatest(floor(ne * 0.7::DOUBLE), 1) + greatest(floor(ne * 0.15::DOUBLE), 1) THEN 'val' ELSE 'test' END AS split, ne, n FROM ep JOIN ec ON ep.label = ec.label),
eg AS (SELECT label FROM ee GROUP BY 1 HAVING any_value(ne) >= 3 AND least(count(*) FILTER (split = 'train'), count(*) FILTER (split = 'val'), count(*) FILTER (split = 'test')) >= greatest(floor(any_value(n) * 0.02), 1)),
es AS (SELECT {K}, label, t, split FROM ee WHERE label IN (SELECT label FROM eg) UNION ALL SELECT {K}, label, t, split FROM rs WHERE split IS NOT NULL AND label NOT IN (SELECT label FROM eg))"""


@query("w03_episodes", with_sql(RARE, EP) + " SELECT label, episode::BIGINT AS episode, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ep GROUP BY 1, 2")
def _(spark, sf):
    e = splits.episodes(rare(spark, sf).where("y > 0"), ["label"], 3 * DAY)
    return e.groupBy("label", "episode").agg(F.sum("n").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("w04_rank_plan", with_sql(CLEAN, rank_sql("clean", "label", 5 * DAY)) + " SELECT label, n AS total, z AS zone, ta AS t_a, tb AS t_b, ia AS i_a, ib AS i_b FROM pl")
def _(spark, sf):
    return splits.rank_plan(clean(spark, sf), ["label"], OPT).select("label", "total", "zone", "t_a", "t_b", "i_a", "i_b")


@query("w04_rank_cut_no_zone", with_sql(CLEAN, rank_sql("clean", "label", 0)) + f" SELECT {K}, split FROM rs")
def _(spark, sf):
    none = SplitOptions(gap_seconds=0)
    c = clean(spark, sf)
    return splits.apply_plan(c, splits.rank_plan(c, ["label"], none), ["label"], TIE).select(*TIE, "split")


@query("t03_episode_split", with_sql(RARE, EPISODE) + f" SELECT {K}, label, split FROM es")
def _(spark, sf):
    return splits.split_flows(rare(spark, sf), "episode", TIE, FEW).select(*TIE, "label", "split")


@query("t04_temporal_split", with_sql(CLEAN, rank_sql("clean", "", 5 * DAY)) + f" SELECT {K}, split FROM rs WHERE split IS NOT NULL")
def _(spark, sf):
    return splits.split_flows(clean(spark, sf), "temporal", TIE, OPT).select(*TIE, "split")


SPAN = lambda src: f"""sp AS (SELECT min(t) + (max(t) - min(t)) * (0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) AS cut, min(t) + (max(t) - min(t)) * 0.7::DOUBLE AS ca,
  min(t) + (max(t) - min(t)) * (0.7::DOUBLE + 0.15::DOUBLE) AS cb, least({5 * DAY}, CAST(floor(greatest((max(t) - min(t)) * 0.05::DOUBLE, 1)) AS BIGINT)) AS g FROM {src})"""


@query("t05_day_holdout", with_sql(CLEAN, "ky AS (SELECT * FROM clean WHERE source_file NOT IN ('1998', '2000'))", SPAN("ky")) + f""" SELECT {K}, 'test' AS split FROM clean WHERE source_file IN ('1998', '2000')
  UNION ALL SELECT {K}, CASE WHEN t < cut - g THEN 'train' ELSE 'val' END FROM ky, sp WHERE t < cut - g OR t > cut + g""")
def _(spark, sf):
    rows = clean(spark, sf).withColumn("capture_day", F.col("source_file"))
    return splits.split_flows(rows, "day_holdout", TIE, OPT, days=["1998", "2000"]).select(*TIE, "split")


HOSTS = """hs AS (SELECT src_ip, row_number() OVER (ORDER BY md5(src_ip || ':0'), src_ip) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT src_ip FROM clean WHERE y > 0)),
hp AS (SELECT src_ip, CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM hs)"""


@query("k09_host_splits", with_sql(CLEAN, HOSTS) + " SELECT src_ip, split FROM hp")
def _(spark, sf):
    return splits.host_splits(clean(spark, sf).where("y > 0").select("src_ip").distinct(), "src_ip", OPT)


@query("t06_host_holdout", with_sql(CLEAN, HOSTS, "bn AS (SELECT * FROM clean WHERE y = 0)", SPAN("bn")) + f""" SELECT {K}, split FROM clean JOIN hp USING (src_ip) WHERE y > 0
  UNION ALL SELECT {K}, CASE WHEN t < ca THEN 'train' WHEN t < cb THEN 'val' ELSE 'test' END FROM bn, sp""")
def _(spark, sf):
    return splits.split_flows(clean(spark, sf), "host_holdout", TIE, OPT).select(*TIE, "split")


@query("t07_attack_holdout", with_sql(RARE, "sn AS (SELECT * FROM rare WHERE label <> 'Botnet')", SPAN("sn"), "hd AS (SELECT min(t) AS lo, max(t) AS hi FROM rare WHERE label = 'Botnet')") + f""" SELECT {K}, 'test' AS split FROM rare, hd WHERE label = 'Botnet' OR (label = 'BENIGN' AND t BETWEEN lo AND hi)
  UNION ALL SELECT {K}, CASE WHEN t < cut - g THEN 'train' ELSE 'val' END FROM sn, sp WHERE t < cut - g OR t > cut + g""")
def _(spark, sf):
    return splits.split_flows(rare(spark, sf), "attack_holdout", TIE, OPT, attacks=["Botnet"]).select(*TIE, "split")


@query("j09_background", with_sql(RARE, "hd AS (SELECT min(t) AS lo, max(t) AS hi FROM rare WHERE label = 'PortScan')") + f" SELECT {K} FROM rare, hd WHERE label = 'BENIGN' AND t BETWEEN lo AND hi")
def _(spark, sf):
    rows = rare(spark, sf)
    return splits.background(rows, rows.where("label = 'PortScan'"), "BENIGN").select(*TIE)


@query("t08_adaptive_gap", with_sql(CLEAN) + f" SELECT label, least(864000000, CAST(floor(greatest((max(t) - min(t)) * 0.05::DOUBLE, 1)) AS BIGINT)) AS gap FROM clean GROUP BY 1")
def _(spark, sf):
    span = clean(spark, sf).groupBy("label").agg((F.max("t") - F.min("t")).alias("span"))
    return span.select("label", splits.adaptive_gap(F.col("span"), 864000000).alias("gap"))


PERFILE = f"""pf AS (SELECT *, CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY t, {K}) - 1 AS rk, count(*) OVER (PARTITION BY source_file) AS n FROM clean))"""


@query("t09_per_file_split", with_sql(CLEAN, PERFILE) + f" SELECT {K}, split FROM pf")
def _(spark, sf):
    return splits.split_flows(clean(spark, sf), "per_file", TIE).select(*TIE, "split")


def per_file(spark, sf):
    return splits.split_flows(clean(spark, sf), "per_file", TIE)


@query("t00_split_report", with_sql(CLEAN, PERFILE) + " SELECT s.split, l.label, (SELECT count(*) FROM pf WHERE pf.split = s.split AND pf.label = l.label) AS n FROM (SELECT DISTINCT split FROM pf) s, (SELECT DISTINCT label FROM pf) l")
def _(spark, sf):
    return splits.split_report(per_file(spark, sf))


@query("u02_missing_labels", with_sql(RARE, rank_sql("rare", "", 5 * DAY)) + " SELECT s.split, l.label FROM (SELECT DISTINCT split FROM rs WHERE split IS NOT NULL AND label <> 'DDoS') s, (SELECT DISTINCT label FROM rs WHERE split IS NOT NULL) l EXCEPT SELECT DISTINCT split, label FROM rs WHERE NOT (label = 'DDoS' AND split = 'val')")
def _(spark, sf):
    s = splits.split_flows(rare(spark, sf), "temporal", TIE, OPT).where("NOT (label = 'DDoS' AND split = 'val')")
    return splits.missing_labels(s)


@query("a39_clip_outliers", with_sql(CLEAN, PERFILE) + f""", q AS (SELECT split, quantile_cont(fwd_bytes, 1 - 0.99::DOUBLE) AS l1, quantile_cont(fwd_bytes, 0.99::DOUBLE) AS h1, quantile_cont(bytes_per_s, 1 - 0.99::DOUBLE) AS l2, quantile_cont(bytes_per_s, 0.99::DOUBLE) AS h2 FROM pf GROUP BY 1)
  SELECT {K}, round(least(greatest(fwd_bytes, l1), h1), 4) AS fwd_bytes, round(least(greatest(bytes_per_s, l2), h2), 4) AS bytes_per_s FROM pf JOIN q USING (split)""")
def _(spark, sf):
    c = splits.clip_outliers(per_file(spark, sf), ["fwd_bytes", "bytes_per_s"], 0.99)
    return c.select(*TIE, r(F.col("fwd_bytes"), "fwd_bytes", 4), r(F.col("bytes_per_s"), "bytes_per_s", 4))


@query("u01_union_of_splits", with_sql(CLEAN) + " SELECT label, count(*) AS n FROM clean GROUP BY 1")
def _(spark, sf):
    c = clean(spark, sf)
    parts = [c.where(F.col("y") == k) for k in range(6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s05_split_table", with_sql(CLEAN, PERFILE) + " SELECT split, label, count(*) AS n, sum(t)::BIGINT AS t_sum FROM pf WHERE split <> 'val' GROUP BY 1, 2")
def _(spark, sf):
    from flowloom.workspace import new_path
    path = splits.splits_path(new_path(spark, "splits"), "cicids6", "per_file", {"sf": sf, "q": 0.999})
    splits.write_splits(per_file(spark, sf).select("split", "label", "t"), path)
    both = splits.read_splits(spark, path, "train").unionByName(splits.read_splits(spark, path, "test"))
    return both.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t_sum"))


@query("w06_row_windows", with_sql(CLEAN) + f" SELECT {K}, (row_number() OVER (ORDER BY t, {K}) - 1) // 500 AS batch FROM clean")
def _(spark, sf):
    return sampling.row_windows(clean(spark, sf), [F.col("t"), *[F.col(c) for c in TIE]], 500).select(*TIE, "batch")


@query("k01_time_order", with_sql(CLEAN) + f" SELECT {K}, row_number() OVER (ORDER BY t, {K}) - 1 AS pos FROM clean")
def _(spark, sf):
    return ordered.row_ranks(clean(spark, sf), [], [F.col("t"), *[F.col(c) for c in TIE]], "pos").select(*TIE, "pos")


@query("k08_edge_cap", "WITH " + windowed_sql() + " SELECT window_id, least(count(*), 150) AS n FROM win GROUP BY 1")
def _(spark, sf):
    from flowloom.plans.graph import cap_edges
    return cap_edges(windowed(spark, sf), 150, TIE, ["window_id"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))


@query("k10_stratified_halves", with_sql(CLEAN) + " SELECT y, CASE WHEN half = 1 THEN 'fit' ELSE 'check' END AS part, CASE WHEN half = 1 THEN greatest(1, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT)) ELSE n - greatest(1, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT)) END AS n FROM (SELECT y, count(*) AS n FROM clean GROUP BY 1), (SELECT unnest([1, 2]) AS half)")
def _(spark, sf):
    return sampling.stratified_halves(clean(spark, sf), "y", TIE, 0.4).groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"))


@query("k13_edge_mask", "WITH " + windowed_sql() + " SELECT window_id, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS masked, count(*) AS n FROM win GROUP BY 1")
def _(spark, sf):
    m = sampling.edge_mask(windowed(spark, sf), 0.15, ["window_id"], TIE)
    return m.groupBy("window_id").agg(F.count_if(F.col("masked")).alias("masked"), F.count(F.lit(1)).alias("n"))


RUNS = f"""ws AS (SELECT source_file, window_id, count(*) AS n, count(*) FILTER (y = 1) AS nt, count(*) FILTER (y = 0) AS nb FROM win GROUP BY 1, 2),
wu AS (SELECT *, (n >= 8 AND nt > 0 AND nb > 0 AND window_id % 3 <> 0)::INT AS u FROM ws),
rn AS (SELECT a.source_file, a.window_id AS first_window, b.window_id AS last_window, (SELECT sum(u) FROM wu c WHERE c.source_file = a.source_file AND c.window_id BETWEEN a.window_id AND b.window_id) AS usable_windows,
  (SELECT sum(n) FROM wu c WHERE c.source_file = a.source_file AND c.window_id BETWEEN a.window_id AND b.window_id) AS n_rows FROM wu a JOIN wu b ON a.source_file = b.source_file AND b.window_id >= a.window_id)
SELECT source_file, first_window, last_window, usable_windows::BIGINT AS usable_windows, n_rows::BIGINT AS n_rows FROM rn WHERE n_rows <= 1500 AND usable_windows > 0
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY usable_windows DESC, n_rows, last_window, first_window DESC) = 1"""


def run_windows(spark, sf):
    w = windowed(spark, sf).groupBy("source_file", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_target"), F.count_if(F.col("y") == 0).alias("n_benign"))
    usable = (F.col("n") >= 8) & (F.col("n_target") > 0) & (F.col("n_benign") > 0) & (F.col("window_id") % 3 != 0)
    return w.withColumn("usable", usable)


@query("w12_best_run", "WITH " + windowed_sql() + ",\n" + RUNS)
def _(spark, sf):
    return sampling.best_runs(run_windows(spark, sf), ["source_file"], 1500)


@query("k11_sample_rows")
def _(spark, sf):
    runs = sampling.best_runs(run_windows(spark, sf), ["source_file"], 1500)
    return sampling.rows_of_runs(windowed(spark, sf), runs, ["source_file"], ["source_file", *TIE]).select("source_file", *TIE)


# ------------------------------------------------------------------- audits
@query("j07_window_company", "WITH " + windowed_sql() + f" SELECT {K}, count(*) FILTER (y = 0) OVER (PARTITION BY window_id) > 0 AS shares_with_benign, count(*) OVER (PARTITION BY window_id) >= 170 AS graphable FROM win")
def _(spark, sf):
    return audits.window_company(windowed(spark, sf), 170).select(*TIE, "shares_with_benign", "graphable")


@query("a35_split_summary", "WITH " + windowed_sql() + """, x AS (SELECT *, count(*) FILTER (y = 0) OVER (PARTITION BY window_id) > 0 AS sh, count(*) OVER (PARTITION BY window_id) >= 170 AS gr FROM win)
  SELECT label, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, count(DISTINCT window_id) AS windows, count(*) FILTER (gr) AS graphable_rows, count(*) FILTER (sh) AS sharing_rows, count(DISTINCT source_file) AS n_files FROM x GROUP BY 1""")
def _(spark, sf):
    return audits.split_summary(windowed(spark, sf), 170)


@query("a35_rows_per_file", with_sql(CLEAN) + " SELECT label, source_file, count(*) AS n FROM clean GROUP BY 1, 2")
def _(spark, sf):
    return audits.rows_per_file(clean(spark, sf))


@query("a36_purged_rows", with_sql(CLEAN, rank_sql("clean", "label", 5 * DAY)) + " SELECT label, count(*) AS n_before, count(split) AS n_after, count(*) - count(split) AS purged FROM rs GROUP BY 1")
def _(spark, sf):
    c = clean(spark, sf)
    kept = splits.apply_plan(c, splits.rank_plan(c, ["label"], OPT), ["label"], TIE)
    return audits.purged_rows(c, kept)


@query("u03_boundary_sharing", with_sql(CLEAN, PERFILE) + """, d AS (SELECT split, label, t, count(*) AS n FROM pf GROUP BY 1, 2, 3)
  SELECT a.label, a.split || '|' || b.split AS boundary, count(*) AS shared_times, sum(a.n)::BIGINT AS left_rows, sum(b.n)::BIGINT AS right_rows FROM d a JOIN d b ON a.label = b.label AND a.t = b.t AND ((a.split = 'train' AND b.split = 'val') OR (a.split = 'val' AND b.split = 'test')) GROUP BY 1, 2""")
def _(spark, sf):
    return audits.boundary_sharing(per_file(spark, sf))


@query("a38_time_resolution", "SELECT event_type AS source_file, count(*) AS n_rows, count(*) FILTER (CAST(floor(epoch(ts)) AS BIGINT) % 60 <> 0) AS off_minute, count(DISTINCT CAST(floor(epoch(ts)) AS BIGINT) % 60) AS distinct_seconds FROM events GROUP BY 1")
def _(spark, sf):
    from flowloom.catalog.tables import table
    e = table(spark, sf, "events").select(F.col("event_type").alias("source_file"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return audits.time_resolution(e)


def _raw(spark, sf):
    from flowloom.catalog.expressions import raw_times
    return raw_times(spark, sf)


def _repaired():
    from flowloom.catalog.expressions import REPAIRED
    return REPAIRED


from flowloom.catalog.tables import FLOWS  # noqa: E402


@query("a37_clock_audit_days", with_sql(FLOWS, _repaired()) + " SELECT source_file, CAST(ts0 AS DATE)::VARCHAR AS day, count(*) AS n_rows, count(*) FILTER (hour(ts0) >= 13) AS hour_ge_13, count(*) FILTER (hour(ts0) BETWEEN 1 AND 7) AS pm_window_rows, 0::BIGINT AS am_pm_tokens, count(*) FILTER (moved) AS moved_rows, bool_or(hour(ts0) >= 13) AND bool_or(hour(ts0) BETWEEN 1 AND 7) AS mixed FROM fx GROUP BY 1, 2")
def _(spark, sf):
    return audits.clock_audit(_raw(spark, sf).select("source_file", "timestamp")).withColumn("day", F.col("day").cast("string"))


@query("a37_clock_audit_files", with_sql(FLOWS, _repaired()) + """, d2 AS (SELECT source_file, CAST(ts0 AS DATE) AS day, bool_or(hour(ts0) >= 13) AND bool_or(hour(ts0) BETWEEN 1 AND 7) AS mixed, count(*) AS n, count(*) FILTER (moved) AS m FROM fx GROUP BY 1, 2)
  SELECT source_file, sum(n)::BIGINT AS n_rows, sum(m)::BIGINT AS moved_rows, count(*) FILTER (mixed) AS mixed_days, CASE WHEN bool_or(mixed) THEN 'MIXED' WHEN sum(m) > 0 THEN 'REPAIRED' ELSE 'CLEAN' END AS verdict FROM d2 GROUP BY 1""")
def _(spark, sf):
    return audits.clock_verdicts(audits.clock_audit(_raw(spark, sf).select("source_file", "timestamp")))
