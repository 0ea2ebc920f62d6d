"""Variants of an edge table for sensitivity studies, and the live-path cost study."""

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.constants import EDGE_FEATURES, NODE_FEATURES
from flowloom.operators import metrics
from flowloom.operators.cleaning import zero_features
from flowloom.operators.ordered import row_ranks
from flowloom.workspace import checked_broadcast

TOKENS = ["src_token", "dst_token", "protocol_token"]

# fixed values: what a switch cannot report
PINNED_TO_ONE = ["fwd_packet_ratio", "byte_asymmetry"]
UNAVAILABLE = ["log_max_fwd_len", "log_max_bwd_len", "syn_ratio", "rst_ratio", "ack_ratio", "psh_ratio",
               "log_iat_mean", "iat_burstiness"]


def without_edge_features(edges, names=EDGE_FEATURES):
    return zero_features(edges, list(names))


def without_tokens(edges):
    return edges.withColumns({t: F.lit(0) for t in TOKENS if t in edges.columns})


def without_node_features(nodes, names=NODE_FEATURES):
    return zero_features(nodes, list(names), NODE_FEATURES)


def leave_one_out(edges, name):
    return zero_features(edges, [name])


def shuffle_columns(df: DataFrame, columns: list[str], ids: list[str], seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """Give every row the given columns of another row: rows in one hash order receive the
    values of the rows in a second hash order (within ``keys``, or over the whole table)."""
    keys = list(keys)

    def order(i):
        return [F.xxhash64(*ids, F.lit(2 * seed + i)), *[F.col(c) for c in ids]]

    rest = [c for c in df.columns if c not in columns]
    takers = row_ranks(df.select(*rest), keys, order(0), "_r")
    givers = row_ranks(df.select(*dict.fromkeys([*keys, *ids, *columns])), keys, order(1), "_r")
    return takers.join(givers.select(*keys, "_r", *columns), [*keys, "_r"]).select(df.columns)


def rewired(edges: DataFrame, ids: list[str], seed: int = 0, key: str = "window_id") -> DataFrame:
    """Both ends of every edge replaced by hosts of its window, drawn by hash."""
    hosts = edges.select(key, F.explode(F.array("src", "dst")).alias("host")).distinct()
    sizes = checked_broadcast(hosts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "window-hosts")
    ranked = row_ranks(hosts, [key], [F.col("host")], "_h")
    out = edges.join(sizes, key)
    for i, end in enumerate(("src", "dst")):
        drawn = out.withColumn("_h", F.pmod(F.xxhash64(*ids, F.lit(seed * 2 + i)), F.col("_n"))).drop(end)
        out = drawn.join(ranked.withColumnRenamed("host", end), [key, "_h"]).drop("_h")
    return out.select(edges.columns)


def permuted_hosts(nodes: DataFrame, seed: int = 0, key: str = "window_id") -> DataFrame:
    """The same graph with every host's identity given to another host of the window."""
    return shuffle_columns(nodes, ["ip"], ["host"], seed, [key])


def degrade_edges(edges: DataFrame) -> DataFrame:
    """What the feature rows look like on the live path."""
    return edges.withColumns({**{c: F.lit(1.0) for c in PINNED_TO_ONE}, **{c: F.lit(0.0) for c in UNAVAILABLE}})


def _picked(only: Column | None, new: Column, old: str) -> Column:
    return new if only is None else F.when(only, new).otherwise(F.col(old))


def degrade_flows(flows: DataFrame, only: Column | None = None) -> DataFrame:
    """One counter per flow: all volume on the forward side, no flags. Rows that are not ``only``
    stay as they are."""
    zero = F.lit(0.0)
    out = flows.withColumns({
        c: _picked(only, F.col(c) + F.col(back), c) for c, back in (("fwd_packets", "bwd_packets"), ("fwd_bytes", "bwd_bytes"))
    })
    return out.withColumns({
        c: _picked(only, zero, c) for c in ("bwd_packets", "bwd_bytes", "syn", "rst", "ack", "psh") if c in flows.columns
    })


def recount_polls(flows: DataFrame, poll: int = 5, idle: float = 0.0, only: Column | None = None) -> DataFrame:
    """Every flow as often as polls would have seen it: on each grid tick strictly after its
    start while it is visible, counters so far, rates over the time since it was installed.
    Rows that are not ``only`` stay as they are, once, without a poll."""
    lived = F.greatest(F.coalesce(F.col("duration_us"), F.lit(0.0)) / 1e6, F.lit(1e-3))
    rows = flows.withColumns({"_t0": F.col("t").cast("double"), "_dur": lived}).withColumns({
        "_visible": F.col("_dur") + idle, "_tick": F.floor(F.col("_t0") / poll) * poll + poll,
    })
    polls = F.floor((F.col("_t0") + F.col("_visible") - F.col("_tick")) / poll) + 1
    rows = rows.withColumn("_polls", F.greatest(polls, F.lit(1)))
    ticks = F.sequence(F.lit(0).cast("bigint"), F.col("_polls") - 1)
    seen = rows.withColumn("poll", F.explode(ticks if only is None else F.when(only, ticks).otherwise(F.array(F.lit(None).cast("bigint")))))
    at = F.col("_tick") + F.col("poll") * poll
    since = F.least(F.greatest(at - F.col("_t0"), F.lit(1e-3)), F.col("_visible"))
    seen = seen.withColumns({"_at": at, "_since": since}).withColumn("_elapsed", F.least("_since", "_dur"))
    share = F.least(F.col("_elapsed") / F.col("_dur"), F.lit(1.0))
    new = {c: F.col(c) * share for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes") if c in flows.columns}
    new |= {c: F.col(c) * (F.col("_elapsed") / F.col("_since")) for c in ("bytes_per_s", "packets_per_s") if c in flows.columns}
    time = F.col("_at").cast("bigint") if only is None else F.col("_at").cast("bigint").cast(flows.schema["t"].dataType)
    out = seen.withColumns({
        **{c: _picked(only, v, c) for c, v in new.items()}, "t": _picked(only, time, "t"),
        "duration_us": _picked(only, F.col("_since") * 1e6, "duration_us"),
    })
    return out.drop("_t0", "_dur", "_visible", "_tick", "_polls", "_at", "_since", "_elapsed")


VARIANTS = ["baseline", "degraded", "recounted", "both"]
TASK_FLOWS = 100_000  # so many flows, four times over, are pooled by a task in its memory


def cost_study(flows: DataFrame, score: Callable[[DataFrame], DataFrame], ids: list[str], n_classes: int) -> DataFrame:
    """Metrics of four variants (baseline, degraded, recounted, both) on the flows all four
    scored. ``score`` adds ``probs``; repeated submissions are pooled per flow.

    The flows are moved once, by ``ids``, before there are variants of them: a task then makes,
    scores and pools all submissions of its flows, and what is written is a table of counts."""
    from flowloom.functions.scoring import argmax
    from flowloom.workspace import materialize

    parts = max(int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-flows.count() // TASK_FLOWS))
    variant = F.col("variant")
    rows = flows.repartition(parts, *ids).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    rows = degrade_flows(recount_polls(rows, only=variant.isin("recounted", "both")), variant.isin("degraded", "both"))
    pooled = metrics.pooled_probabilities(score(rows), ["variant", *ids, "y"], n_classes)
    scored = pooled.select("variant", *ids, "y", argmax(F.col("probs")).alias("pred"))
    per_flow = scored.groupBy(*ids).agg(F.collect_list(F.struct("variant", "y", "pred")).alias("_rows"))
    shared = F.size(F.array_distinct("_rows.variant")) == len(VARIANTS)
    for c in ids:
        shared = shared & F.col(c).isNotNull()  # a flow without one of its ids is the same as no other
    told = per_flow.select(shared.alias("_shared"), F.explode("_rows").alias("_r")).select("_shared", "_r.*")
    counts = materialize(told.groupBy("_shared", "variant", "y", "pred").agg(F.count(F.lit(1)).alias("n")), "cost-study")
    coverage = counts.groupBy("variant").agg(F.sum("n").alias("n_scored"))
    cm = counts.where("_shared").select("variant", "y", "pred", "n")
    return metrics.summary_metrics(cm, n_classes, ["variant"]).join(coverage, "variant")
