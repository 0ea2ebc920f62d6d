"""Small tables with known answers, and brute force for what SQL cannot check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.constants import FEATURE_COLUMNS, RATE_COLUMNS
from flowloom.functions import addresses, clock, ports
from flowloom.operators import audits, cleaning, hosts, metrics, openset, ordered, rules, sampling, splits, studies, views
from flowloom.plans.graph import cap_edges
from flowloom.settings import SplitOptions
from flowloom.sources import dumps, packets
from flowloom.streaming import state


def test_clock_repair_known_answers(spark):
    rows = [("a", "7/7/2017 3:57"), ("a", "7/7/2017 10:42"), ("a", "7/7/2017 12:05"), ("a", "7/7/2017 2:55")]
    df = clock.repair_clock(clock.parse_timestamps(spark.createDataFrame(rows, "f string, timestamp string"), "timestamp"))
    got = sorted((r.ts.hour, r.moved) for r in df.collect())
    assert got == [(10, False), (12, False), (14, True), (15, True)]
    full = spark.createDataFrame([("03/07/2017 03:57:10",), ("03/07/2017 16:01:00",)], "timestamp string")
    got = clock.repair_clock(clock.parse_timestamps(full, "timestamp")).collect()
    assert sorted(r.ts.hour for r in got) == [3, 16] and not any(r.moved for r in got)
    marked = spark.createDataFrame([("7/7/2017 3:57 AM",), ("7/7/2017 10:42 AM",)], "timestamp string")
    got = clock.repair_clock(clock.parse_timestamps(marked, "timestamp")).collect()
    assert sorted(r.ts.hour for r in got) == [3, 10]


def test_addresses_and_tokens(spark):
    df = spark.createDataFrame([("10.0.0.1", 22.0), ("fe80::1", float("nan")), ("1.x.2.3", -1.0), ("1.2.3", 70000.0)], "ip string, p double")
    got = df.select(addresses.ipv4_to_int(F.col("ip")).alias("v"), ports.port_token(F.col("p")).alias("t")).collect()
    assert [r.v for r in got] == [167772161, 0, 16777216 + 2 * 256 + 3, 0]
    assert [r.t for r in got] == [3, 1, 1, 1]


def test_ranks_and_totals_match_pandas_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(0 if i % 3 == 0 else int(rng.integers(1, 40)), int(rng.integers(0, 50)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = ordered.running_totals(df, ["k"], [F.desc("v"), F.col("id")], {"n": F.lit(1).cast("bigint"), "s": F.col("v")}, parts=7).toPandas()
    want = got.sort_values(["k", "v", "id"], ascending=[True, False, True])
    assert (want.groupby("k").cumcount() == want.n_before).all()
    assert (want.groupby("k").v.cumsum() - want.v == want.s_before).all()
    ranks = ordered.row_ranks(df, [], [F.col("v"), F.col("id")]).toPandas().sort_values(["v", "id"])
    assert list(ranks["rank"]) == list(range(3000))


def test_percentiles_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=501).round(2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, x double")
    got = {(r.g, r.prob): r.value for r in ordered.exact_percentiles(df, ["g"], ["x"], [0.001, 0.5, 0.999]).collect()}
    for g in (0, 1):
        for p in (0.001, 0.5, 0.999):
            assert got[(g, p)] == pytest.approx(np.quantile(x[g::2], p), abs=1e-9)


def test_gaps_with_ties_match_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{rng.integers(3)}", f"d{rng.integers(3)}", int(rng.integers(0, 30)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, t bigint, id int")
    got = {r.id: (r.dt_pair, r.dt_src) for r in hosts.time_since_contact(df, ["id"]).collect()}
    pair, src = {}, {}
    for s, d, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        assert got[i] == (float(t - pair[(s, d)]) if (s, d) in pair else 86400.0, float(t - src[s]) if s in src else 86400.0)
        pair[(s, d)] = src[s] = t


def test_scan_has_high_port_entropy_and_flood_high_fan_in(spark):
    scan = [(0, 1, 2, p, 10.0, p) for p in range(200)]
    flood = [(0, 100 + i, 9, 80, 10.0, i) for i in range(200)]
    block = hosts.node_block(spark.createDataFrame(scan + flood, "window_id int, src bigint, dst bigint, dst_token int, total_bytes double, t int"))
    by = {r.host: r for r in block.collect()}
    assert by[1].dst_port_entropy == pytest.approx(math.log(200), abs=1e-3) and by[1].unique_dst_ports == 200
    assert by[9].unique_src_ips == 200 and by[9].out_degree == 0


def test_edge_cap_is_exact_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("window_id"), "id").where("window_id < 2 OR id < 60")
    once = cap_edges(df, 100, ["id"], ["window_id"]).toPandas()
    again = cap_edges(df.repartition(5), 100, ["id"], ["window_id"]).toPandas()
    assert once.groupby("window_id").size().to_dict() == {0: 100, 1: 100, 2: 20}
    assert set(once.id) == set(again.id)


def test_window_company_and_best_run(spark):
    rows = [(5, 0)] + [(10 + i, 1) for i in range(9)] + [(130 + i, 1) for i in range(3)] + [(200, 2)]
    df = hosts.assign_windows(spark.createDataFrame(rows, "t bigint, y int"), 60)
    got = audits.window_company(df, 8).groupBy("y").agg(F.count_if("shares_with_benign").alias("s"), F.count_if("graphable").alias("g"), F.count(F.lit(1)).alias("n"))
    assert {r.y: (r.n, r.s, r.g) for r in got.collect()} == {0: (1, 1, 1), 1: (12, 9, 9), 2: (1, 0, 0)}
    w = spark.createDataFrame([(0, i, 10, i in (1, 2, 4)) for i in range(5)], "k int, window_id bigint, n bigint, usable boolean")
    r = sampling.best_runs(w, ["k"], 45).first()
    assert (r.first_window, r.last_window, r.usable_windows, r.n_rows) == (1, 4, 3, 40)
    assert sampling.best_runs(w.withColumn("usable", F.lit(False)), ["k"], 45).count() == 0


def test_cut_inside_one_second_keeps_positions(spark):
    df = spark.createDataFrame([(7, i, "x") for i in range(100)], "t bigint, id int, label string")
    out = splits.split_temporal(df, SplitOptions(gap_seconds=0), ["id"]).toPandas()
    assert out.groupby("split").id.agg(["min", "max"]).loc[["train", "val", "test"]].values.tolist() == [[0, 69], [70, 84], [85, 99]]


def test_dump_lines(spark):
    lines = [
        "cookie=0x0, duration=16.959s, table=0, n_packets=10, n_bytes=840, tcp,nw_src=10.0.0.1,nw_dst=10.0.0.2,tp_src=5,tp_dst=80,tcp_flags=0x12 actions=NORMAL",
        "cookie=0x0, duration=2s, n_packets=1, n_bytes=42, arp,arp_spa=10.0.0.1,arp_tpa=10.0.0.3 actions=NORMAL", "NXST_FLOW reply",
        " duration=1.5s, n_packets=3, n_bytes=9, icmp,nw_src=10.0.0.4,nw_dst=10.0.0.5,icmp_type=8 actions=drop",
    ]
    got = dumps.parse_dump(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.protocol, r.dst_port, r.packet_count, r.tcp_flags) for r in got] == [("TCP", 80, 10, 18), ("ARP", 0, 1, 0), ("ICMP", 0, 3, 0)]
    assert got[0].duration_sec == pytest.approx(16.959)


def test_rules_one_edge_cases(spark):
    policy = rules.policy_table(spark)

    def outcome(cls, conf, threat=0.9, allow=None):
        df = spark.createDataFrame([(1, "10.0.0.1", "10.0.0.2", 6, 22, cls, conf, threat, 1)], "window_id int, src_ip string, dst_ip string, protocol int, dst_port int, attack_class string, confidence double, src_threat double, id int")
        a = spark.createDataFrame([(allow,)], "ip string") if allow else None
        return rules.translate(df, policy, ["id"], allow=a, corroboration=0.5).first().outcome

    assert outcome("BruteForce", 0.9) == "rule"
    assert outcome("BruteForce", 0.8) == "below_floor"
    assert outcome("PortScan", 0.99) == "class_suppressed"
    assert outcome("DDoS", 0.99) == "no_policy"
    assert outcome("BruteForce", 0.9, allow="10.0.0.2") == "allowlisted"
    assert outcome("BruteForce", 0.9, threat=0.1) == "node_corroboration_absent"


def test_unknown_feature_name_is_an_error(spark):
    with pytest.raises(ValueError):
        cleaning.zero_features(spark.range(1), ["Total Fwd Packets"])


def test_timeline_windows():
    assert views.window_minutes("7d") == (10080, 360) and views.window_minutes("90min") == (90, 15)
    for bad in ("0h", "31d", "soon"):
        with pytest.raises(ValueError):
            views.window_minutes(bad)


def test_class_offsets_fix_a_shifted_boundary(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(4000):
        y = i % 2
        z = rng.normal(2.0 if y else -2.0) - 3.0  # class 1 ranks well but never wins
        p = 1 / (1 + math.exp(-z))
        rows.append((y, [1 - p, p], "fit" if i % 5 < 3 else "check"))
    df = spark.createDataFrame(rows, "y int, probs array<double>, part string")
    offsets = metrics.fit_class_offsets(df, 2, rounds=2, grid=17)
    assert offsets[0] == 0.0 and 1.5 < offsets[1] < 4.5
    assert metrics.fit_class_offsets(df, 2, min_support=10**6) == [0.0, 0.0]


def test_study_without_effect_is_refused(spark):
    df = spark.createDataFrame([(1, 0, [0.5, 0.5], 0)], "id int, y int, probs array<double>, pred int")
    with pytest.raises(ValueError):
        metrics.require_change(metrics.prediction_changes(df, df, ["id"]))


def test_mixture_and_update_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.diag([1.0, 2.0, 0.5]) + 4
    df = spark.createDataFrame([(0, v.tolist()) for v in x], "label int, z array<double>")
    comps = openset.fit_mixture(df, "z", "label", 3, k=1)
    assert np.allclose(comps[0]["mean"], x.mean(0))
    d = openset.mahalanobis(df, "z", comps).toPandas()
    inv = np.linalg.inv(np.array(comps[0]["cov"]))
    want = [(v - x.mean(0)) @ inv @ (v - x.mean(0)) for v in x]
    assert np.allclose(d.distance, want)
    sums = [r.asDict() for r in openset.accepted_sums(openset.mahalanobis(df, "z", comps), "z", 3, 4.0).collect()]
    after = state.gated_update(comps, sums)[0]
    sel, mean, cov = x[np.array(want) <= 4.0], x.mean(0), np.array(comps[0]["cov"])
    a = 1 - 0.5 ** (1 / 50)
    new = mean + a * (sel - mean).mean(0)
    cov = (1 - a) * cov + a * ((sel - mean).T @ (sel - new)) / len(sel)
    cov = 0.98 * cov + 0.02 * np.array(comps[0]["cov0"])
    assert np.allclose(after["mean"], new) and np.allclose(after["cov"], (cov + cov.T) / 2 + 1e-6 * np.eye(3))


def test_adaptive_threshold_matches_a_loop(spark):
    rng = np.random.default_rng(7)
    now = spark.createDataFrame([("a", 0.01, [float(i) / 100 for i in range(100)])], state.THRESHOLD_STATE)
    alpha, buf = 0.01, [i / 100 for i in range(100)]
    for step in range(2):
        scores = rng.uniform(0, 1.2, 50)
        rows = spark.createDataFrame([("a", float(s), i) for i, s in enumerate(scores)], "segment string, score double, id int")
        got = state.threshold_step(now, rows, ["id"]).first()
        thr = np.percentile(buf, 100 * (1 - alpha))
        err = float((scores > thr).mean() > 0.01)
        alpha = min(max(alpha + 0.01 * (0.01 - err), 1e-4), 0.5)
        buf = (buf + scores.tolist())[-2000:]
        assert got.threshold == pytest.approx(thr) and got.alpha == pytest.approx(alpha) and np.allclose(got.scores, buf)
        now = spark.createDataFrame([("a", got.alpha, got.scores)], state.THRESHOLD_STATE)


def test_packets_split_on_idle_time(spark):
    rows = [("a", "b", 1, 2, 6, t, 100, 2) for t in (0.0, 0.5, 60.5, 121.0)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ts double, size int, flags int")
    got = sorted((r.t, r.fwd_packets, r.syn) for r in packets.packets_to_flows(df, 60.0).collect())
    assert got == [(0.0, 3, 3), (121.0, 1, 1)]


def test_recount_follows_the_poll_grid(spark):
    df = spark.createDataFrame([(3, 30e6, 60.0)], "t bigint, duration_us double, fwd_packets double")
    got = sorted((r.t, round(r.fwd_packets, 6)) for r in studies.recount_polls(df).collect())
    assert [t for t, _ in got] == [5, 10, 15, 20, 25, 30] and got[-1][1] == pytest.approx(54.0)


def test_shuffle_keeps_every_value(spark):
    df = spark.range(500).select("id", F.col("id").alias("v"))
    out = studies.shuffle_columns(df, ["v"], ["id"]).toPandas()
    assert sorted(out.v) == list(range(500)) and (out.v != out.id).mean() > 0.9


def test_file_report_names_what_a_header_lacks(spark, tmp_path):
    from flowloom.sources.csv import inspect_files

    (tmp_path / "a.csv").write_text(" Source IP,Destination IP, Protocol,Timestamp,Label\n1,2,6,3,x\n", encoding="latin-1")
    (tmp_path / "b.csv").write_text("Destination Port,Other\n80,1\n", encoding="latin-1")
    rows = {r.file[-5:]: r for r in inspect_files(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")]).collect()}
    a, b = rows["a.csv"], rows["b.csv"]
    assert (a.has_protocol, a.n_columns, a.missing) == (True, 5, ["src_port", "dst_port"])
    assert ("source ip", "src_ip") in [(p.cell, p.name) for p in a.renames]
    assert (b.has_protocol, b.n_columns) == (False, 2) and "src_ip" in b.missing and len(b.renames) == 1


def test_windows_above_any_size_keep_all_edges(spark):
    from flowloom.plans.graph import build_edges
    from flowloom.settings import WindowOptions

    assert WindowOptions().max_edges is None
    edges = spark.range(205_000).select(
        F.lit(0).alias("window_id"), F.col("id"), F.lit(0.0).alias("window_start"), F.lit(60.0).alias("window_end"),
        *[F.lit(1.0).alias(c) for c in FEATURE_COLUMNS + RATE_COLUMNS], F.lit(1).alias("src"), F.lit(2).alias("dst"),
        *[F.lit(1).alias(c) for c in ("src_token", "dst_token", "protocol_token", "y", "src_port", "dst_port", "protocol")],
        F.lit(1).alias("t"), F.lit(0.0).alias("dt_pair"), F.lit(0.0).alias("dt_src"), F.lit(2.0).alias("total_bytes"),
    )
    assert build_edges(edges, WindowOptions(add_reverse_edges=False), ["id"]).count() == 205_000
