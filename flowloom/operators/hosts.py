"""Per-window host structure: degrees, distinct peers, entropies, timing, history, labels.

Everything starts from pre-aggregated counts. A hot host or a hot window is reduced on the
map side before any shuffle, and the only window functions run over tables whose group size
is bounded: by the seconds in a window, by the windows of a host, or by the number of
different count values (at most the square root of twice the flows).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.constants import EPS
from flowloom.workspace import checked_broadcast


# ----------------------------------------------------------------- windows
def assign_windows(
    df: DataFrame, seconds: int, t: str = "t", by: list[str] = (), anchor: str = "first",
    origin: int | None = None,
) -> DataFrame:
    """Tumbling windows. ``first`` starts the grid at the earliest flow (per ``by`` group,
    such as a split: a handful of rows), ``epoch`` at multiples of the width. A known ``origin``
    saves the search for the earliest flow."""
    if anchor == "epoch" or origin is not None:
        start = F.lit(0 if anchor == "epoch" else origin)
        timed = df
    else:
        first = df.groupBy(*by).agg(F.min(t).alias("_t0"))
        timed = df.join(F.broadcast(first), list(by)) if by else df.crossJoin(F.broadcast(first))
        start = F.col("_t0")
    window = F.floor((F.col(t) - start) / seconds)
    return timed.withColumns({
        "window_id": window,
        "window_start": (start + window * seconds).cast("double"),
        "window_end": (start + (window + 1) * seconds).cast("double"),
    }).drop("_t0")


def assign_sliding_windows(
    df: DataFrame, seconds: int, stride: int, t: str = "t", origin: int | None = None
) -> DataFrame:
    """Overlapping windows on the fixed grid ``first t + k * stride``; one row per flow and
    covering window, at most ``ceil(seconds / stride)`` of them."""
    first = df.agg(F.min(t).alias("_t0")) if origin is None else None
    timed = df.withColumn("_t0", F.lit(origin)) if first is None else df.crossJoin(F.broadcast(first))
    offset = F.col(t) - F.col("_t0")
    last = F.floor(offset / stride)
    earliest = F.greatest(F.floor((offset - seconds) / stride) + 1, F.lit(0))
    out = timed.withColumn("window_id", F.explode(F.sequence(earliest, last)))
    return out.withColumns({
        "window_start": (F.col("_t0") + F.col("window_id") * stride).cast("double"),
        "window_end": (F.col("_t0") + F.col("window_id") * stride + seconds).cast("double"),
    }).drop("_t0")


def keep_full_windows(df: DataFrame, min_edges: int, keys: list[str] = ("window_id",)) -> DataFrame:
    """Rows of the windows with enough flows. The list of windows is small and sent to every task
    after a check of its size, so a flood window is not gathered by its number."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_edges)
    return df.join(checked_broadcast(sizes.drop("_n"), "full-windows"), list(keys), "left_semi")


# --------------------------------------------------------- time since contact
def time_since_contact(df: DataFrame, tie: list[str], first_contact: int = 86400,
                       scope: list[str] = ()) -> DataFrame:
    """Adds ``dt_pair`` and ``dt_src``.

    Rows are reduced to distinct (pair, second) first; a row that is not the first of its
    second has a gap of 0. The lag then runs over distinct seconds of one pair or source,
    whose number the capture length bounds, however many flows the pair has.
    ``scope`` restarts the gaps (for example per window or per split).
    """
    scope = list(scope)
    # one numeric tie column keeps the aggregate in generated hash code
    order = F.col(tie[0]) if len(tie) == 1 else F.struct(*tie)
    pairs = df.groupBy(*scope, "src_ip", "dst_ip", "t").agg(F.min(order).alias("_pair_first"))
    sources = pairs.groupBy(*scope, "src_ip", "t").agg(F.min("_pair_first").alias("_src_first"))

    def previous(keys):
        return F.lag("t").over(Window.partitionBy(*scope, *keys).orderBy("t"))

    sources = sources.withColumn("_src_prev", previous(["src_ip"]))
    pairs = pairs.withColumn("_pair_prev", previous(["src_ip", "dst_ip"]))
    gaps = pairs.join(sources, [*scope, "src_ip", "t"])

    def gap(prev, first):
        since = F.greatest(F.col("t") - F.col(prev), F.lit(0)).cast("double")
        start = F.when(F.col(prev).isNull(), float(first_contact)).otherwise(since)
        return F.when(order == F.col(first), start).otherwise(F.lit(0.0))

    rows = df.join(gaps, [*scope, "src_ip", "dst_ip", "t"])
    return rows.withColumns({
        "dt_pair": gap("_pair_prev", "_pair_first"), "dt_src": gap("_src_prev", "_src_first"),
    }).drop("_pair_first", "_src_first", "_pair_prev", "_src_prev")


# ------------------------------------------------------------- distinct, entropy
def count_values(df: DataFrame, group: list[str], value: list[str], n: Column | None = None) -> DataFrame:
    """(group, value, n): the first level of every distinct count and entropy."""
    return df.groupBy(*group, *value).agg(
        (F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")
    )


def distinct_and_entropy(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, total, n_distinct, entropy) from ``count_values``.

    Values with the same count add the same term, so they are collapsed to (count, how many)
    before the shares are taken."""
    sizes = counts.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("m"))
    total = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*group))
    share = F.col("n") / F.col("_total")
    return sizes.withColumn("_total", total).groupBy(*group).agg(
        F.first("_total").alias("total"),
        F.sum("m").alias("n_distinct"),
        F.sum(-share * F.log(share + EPS) * F.col("m")).alias("entropy"),
    )


def grouped_distinct(df: DataFrame, group: list[str], value: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*group).agg(count(value).alias("n_distinct"))


# ------------------------------------------------------------------ node block
def reciprocity(pairs: DataFrame, keys: list[str] = ("window_id",)) -> DataFrame:
    """(keys, src, dst, n, answered): was there a flow back in the same window?

    Both directions of an unordered pair meet in one aggregate; no self-join is needed."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    forward = F.col("src") <= F.col("dst")
    both = pairs.groupBy(*keys, a.alias("_a"), b.alias("_b")).agg(
        F.sum(F.when(forward, F.col("n")).otherwise(0)).alias("_ab"),
        F.sum(F.when(~forward, F.col("n")).otherwise(0)).alias("_ba"),
    )
    loop = F.col("_a") == F.col("_b")
    answered = (F.col("_ab") > 0) & (F.col("_ba") > 0)
    ways = F.array(
        F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst"), F.col("_ab").alias("n")),
        F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst"), F.col("_ba").alias("n")),
    )
    rows = both.select(*keys, (answered | loop).alias("answered"), F.explode(ways).alias("w"))
    return rows.select(*keys, "w.src", "w.dst", "w.n", "answered").where(F.col("n") > 0)


def inter_flow_times(df: DataFrame, group: list[str], t: str = "t") -> DataFrame:
    """(group, mean_dt, sq_dt): gaps between successive flows of a source in a window.

    Gaps inside one second are 0, so distinct seconds are enough for the squares and the sum
    of gaps is last minus first."""
    seconds = df.groupBy(*group, t).agg(F.count(F.lit(1)).alias("n"))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*group).orderBy(t))
    gaps = seconds.withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("double"))
    count = F.greatest(F.sum("n") - 1, F.lit(1))
    return gaps.groupBy(*group).agg(
        (F.sum("_gap") / count).alias("mean_dt"),
        (F.sum(F.col("_gap") * F.col("_gap")) / count).alias("sq_dt"),
    )


def node_block(edges: DataFrame, keys: list[str] = ("window_id",)) -> DataFrame:
    """One row per (window, host) with every sum the node features need.

    ``edges`` has src, dst, dst_token, total_bytes and t. Flows are combined to
    (window, src, dst, token) and (window, src, second) counts before they are shuffled; the
    rest works on those.
    """
    keys = list(keys)
    pairs = edges.groupBy(*keys, "src", "dst", "dst_token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("b")
    )
    views = F.array(
        F.struct(F.col("src").alias("host"), F.lit("peer_out").alias("view"),
                 F.col("dst").cast("string").alias("value")),
        F.struct(F.col("src").alias("host"), F.lit("port_out").alias("view"),
                 F.col("dst_token").cast("string").alias("value")),
        F.struct(F.col("dst").alias("host"), F.lit("peer_in").alias("view"),
                 F.col("src").cast("string").alias("value")),
    )
    seen = pairs.select(*keys, F.explode(views).alias("v"), "n", "b").select(*keys, "v.*", "n", "b")
    counts = seen.groupBy(*keys, "host", "view", "value").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    sizes = counts.groupBy(*keys, "host", "view", "n").agg(
        F.count(F.lit(1)).alias("m"), F.sum("b").alias("b")
    )
    total = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*keys, "host", "view"))
    share = F.col("n") / F.col("_total")
    sized = sizes.withColumn("_total", total)

    def of(view, value):
        return F.coalesce(F.sum(F.when(F.col("view") == view, value)), F.lit(0))

    def entropy(view):
        return F.coalesce(
            F.sum(F.when(F.col("view") == view, -share * F.log(share + EPS) * F.col("m"))), F.lit(0.0)
        )

    flows = F.col("n") * F.col("m")
    block = sized.groupBy(*keys, "host").agg(
        of("peer_out", flows).alias("out_degree"), of("peer_in", flows).alias("in_degree"),
        of("peer_out", F.col("m")).alias("unique_dst_ips"),
        of("peer_in", F.col("m")).alias("unique_src_ips"),
        of("port_out", F.col("m")).alias("unique_dst_ports"),
        entropy("port_out").alias("dst_port_entropy"), entropy("peer_out").alias("peer_entropy"),
        of("peer_out", F.col("b")).cast("double").alias("bytes_out"),
        of("peer_in", F.col("b")).cast("double").alias("bytes_in"),
    )
    answered = (
        reciprocity(pairs.groupBy(*keys, "src", "dst").agg(F.sum("n").alias("n")), keys)
        .where("answered").groupBy(*keys, F.col("src").alias("host"))
        .agg(F.sum("n").alias("answered_flows"))
    )
    seconds = edges.groupBy(*keys, "src", "t").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys, "src").orderBy("t"))
    timing = (
        seconds.withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("double"))
        .groupBy(*keys, F.col("src").alias("host"))
        .agg(
            (F.sum("_gap") / F.greatest(F.sum("n") - 1, F.lit(1))).alias("mean_dt"),
            (F.sum(F.col("_gap") * F.col("_gap")) / F.greatest(F.sum("n") - 1, F.lit(1))).alias("sq_dt"),
        )
    )
    return (
        block.join(answered, [*keys, "host"], "left").join(timing, [*keys, "host"], "left")
        .fillna(0, subset=["answered_flows"]).fillna(0.0, subset=["mean_dt", "sq_dt"])
    )


def node_labels(edges: DataFrame, keys: list[str] = ("window_id",)) -> DataFrame:
    """(keys, host, y): the most frequent attack class over both ends of a host's flows, the
    lowest index on a tie, 0 when there is none."""
    ends = F.explode(F.array("src", "dst")).alias("host")
    counts = edges.groupBy(*keys, "src", "dst", "y").agg(F.count(F.lit(1)).alias("n"))
    votes = counts.select(*keys, ends, "y", "n").groupBy(*keys, "host", "y").agg(F.sum("n").alias("n"))
    attack = F.col("y") > 0
    best = F.max(F.when(attack, F.struct("n", (-F.col("y")).alias("neg")))).alias("_best")
    return votes.groupBy(*keys, "host").agg(best).select(
        *keys, "host", F.coalesce(-F.col("_best.neg"), F.lit(0)).cast("int").alias("y")
    )


def host_history(nodes: DataFrame, order: list[str] = ("window_id",), flows: str = "flows_now") -> DataFrame:
    """Adds what was known of a host before each of its windows: how many windows, and its
    mean flows per window. One row per (host, window) goes in."""
    before = (
        Window.partitionBy("host").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.count(F.lit(1)).over(before)
    past = F.coalesce(F.sum(flows).over(before), F.lit(0))
    return nodes.withColumns({"windows_before": seen, "_past": past}).withColumn(
        "mean_flows_before", F.col("_past") / F.greatest(F.col("windows_before"), F.lit(1))
    ).drop("_past")


def host_weights(nodes: DataFrame, keys: list[str] = ("window_id",), rho: float = 0.5,
                 cap: float = 5.0) -> DataFrame:
    """``degree^-rho`` over the window mean, capped. The mean comes from an aggregate that is
    joined back, so no window's hosts are gathered in one task."""
    degree = F.greatest(F.col("out_degree") + F.col("in_degree"), F.lit(1))
    raw = nodes.select(*keys, "host", F.pow(degree.cast("double"), F.lit(-rho)).alias("_w"))
    mean = raw.groupBy(*keys).agg(F.avg("_w").alias("_mean"))
    share = F.col("_w") / F.greatest(F.col("_mean"), F.lit(1e-6))
    return raw.join(mean, list(keys)).select(
        *keys, "host", F.least(share, F.lit(cap)).alias("weight")
    )
