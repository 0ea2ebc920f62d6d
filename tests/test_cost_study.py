"""The four-variant study against Python, and how often it moves the flows."""

import math
import random

from pyspark.sql import functions as F

from flowloom.operators import studies

IDS = ["k1", "k2"]


def score(rows):
    """Three probabilities; large submissions of some flows are not scored."""
    x = F.log1p("fwd_bytes") + F.col("bwd_packets") / (F.col("fwd_packets") + 1) + F.col("bytes_per_s") / 1000
    w = [F.exp(-F.abs(x - c)) for c in (2.0, 4.0, 6.0)]
    total = w[0] + w[1] + w[2]
    return rows.where("fwd_bytes < 180 OR variant_free").withColumn("probs", F.array(*[v / total for v in w]))


def poll(f):
    """All submissions of a flow as its polls saw it, as (fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, bytes_per_s)."""
    dur = max(f["duration_us"] / 1e6, 1e-3)
    tick = f["t"] // 5 * 5 + 5
    for p in range(max(math.floor((f["t"] + dur - tick) / 5) + 1, 1)):
        since = min(max(tick + p * 5 - f["t"], 1e-3), dur)
        share = min(min(since, dur) / dur, 1.0)
        yield {**f, **{c: f[c] * share for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")}, "bytes_per_s": f["bytes_per_s"] * (min(since, dur) / since)}


def degrade(f):
    return {**f, "fwd_packets": f["fwd_packets"] + f["bwd_packets"], "fwd_bytes": f["fwd_bytes"] + f["bwd_bytes"], "bwd_packets": 0.0, "bwd_bytes": 0.0}


def probabilities(f):
    if not (f["fwd_bytes"] < 180 or f["variant_free"]):
        return None
    x = math.log1p(f["fwd_bytes"]) + f["bwd_packets"] / (f["fwd_packets"] + 1) + f["bytes_per_s"] / 1000
    w = [math.exp(-abs(x - c)) for c in (2.0, 4.0, 6.0)]
    return [v / sum(w) for v in w]


def by_hand(flows):
    makers = {
        "baseline": lambda f: [f], "degraded": lambda f: [degrade(f)], "recounted": lambda f: list(poll(f)),
        "both": lambda f: [degrade(g) for g in poll(f)],
    }
    pred = {}
    for name, make in makers.items():
        pools = {}
        for f in flows:
            for p in filter(None, map(probabilities, make(f))):
                pools.setdefault((f["k1"], f["k2"], f["y"]), []).append(p)
        pred[name] = {k: max(range(3), key=lambda c: sum(p[c] for p in ps)) for k, ps in pools.items()}
    seen = [{k[:2] for k in p} for p in pred.values()]
    common = {k for k in set.intersection(*seen) if None not in k}
    return {
        name: (len(p), sum(1 for k, c in p.items() if k[:2] in common and c == k[2]) / sum(1 for k in p if k[:2] in common))
        for name, p in pred.items()
    }


def made(spark):
    rnd = random.Random(4)
    flows = []
    for i in range(400):
        flows.append({
            "k1": i, "k2": None if i % 41 == 0 else i % 7, "t": rnd.randrange(1000), "y": rnd.randrange(3), "duration_us": rnd.choice([0.0, 2e6, 11e6, 23e6]),
            "fwd_packets": float(rnd.randrange(1, 20)), "bwd_packets": float(rnd.randrange(9)), "fwd_bytes": rnd.random() * 200,
            "bwd_bytes": rnd.random() * 90, "bytes_per_s": rnd.random() * 900, "variant_free": rnd.random() < 0.7,
        })
    flows += [dict(f) for f in flows[:30]] + [{**f, "y": (f["y"] + 1) % 3} for f in flows[30:50]]  # flows that share their ids
    schema = "k1 bigint, k2 bigint, t bigint, y int, duration_us double, fwd_packets double, bwd_packets double, fwd_bytes double, bwd_bytes double, bytes_per_s double, variant_free boolean"
    return flows, spark.createDataFrame([tuple(f.values()) for f in flows], schema).repartition(3)


def test_the_study_is_that_of_a_loop(spark):
    flows, df = made(spark)
    got = {r.variant: (r.n_scored, r.accuracy) for r in studies.cost_study(df, score, IDS, 3).collect()}
    want = by_hand(flows)
    assert set(got) == set(want)
    for name, (n, accuracy) in want.items():
        assert got[name][0] == n and abs(got[name][1] - accuracy) < 1e-9


def test_flows_are_moved_once_and_not_written(spark, monkeypatch):
    from flowloom import workspace

    plans, rows, write = [], [], workspace.materialize

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(workspace, "materialize", watched)
    _, df = made(spark)
    studies.cost_study(df, score, IDS, 3).collect()
    moved = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2  # the flows by their ids, and counts
    assert "pred" in moved[0] and moved[1].split("hashpartitioning(")[1].startswith("k1")
    assert sum(rows) <= 2 * 4 * 3 * 3
