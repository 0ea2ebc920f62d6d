"""Window graphs: one node table and one edge table per split."""

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.addresses import int_to_ipv4, ipv4_to_int, is_private, subnet_key
from flowloom.functions.features import edge_features, node_features
from flowloom.functions.ports import port_token, protocol_token
from flowloom.operators import hosts
from flowloom.operators.cleaning import zero_features
from flowloom.settings import WindowOptions
from flowloom.workspace import checked_broadcast, materialize


class _Placement:
    """Windows, node ids and tokens of flows, and which windows are full.

    The earliest time is looked up once, in the time column alone, and then is a value in every
    plan; window sizes need the time column alone as well."""

    def __init__(self, flows: DataFrame, options: WindowOptions, by: list[str]):
        self.flows, self.options, self.by = flows, options, list(by)
        self.sliding = bool(options.stride and options.stride != options.seconds)
        self.origin = None
        if self.sliding or (options.anchor == "first" and not self.by):
            self.origin = flows.agg(F.min("t")).first()[0]
        sizes = self.place(flows.select(*self.by, "t")).groupBy(*self.by, "window_id").agg(F.count(F.lit(1)).alias("_n"))
        self.full = checked_broadcast(sizes.where(F.col("_n") >= options.min_edges).drop("_n"), "full-windows")

    def place(self, df: DataFrame) -> DataFrame:
        o = self.options
        if self.sliding:
            return hosts.assign_sliding_windows(df, o.seconds, o.stride, origin=self.origin)
        return hosts.assign_windows(df, o.seconds, by=self.by, anchor=o.anchor, origin=self.origin)

    def coded(self) -> DataFrame:
        """Ids and tokens are made in the scan stage, and only they travel through shuffles."""
        def node(ip):
            value = ipv4_to_int(F.col(ip))
            return subnet_key(value, self.options.subnet_prefix) if self.options.subnet_prefix else value

        return self.flows.withColumns({
            "src": node("src_ip"), "dst": node("dst_ip"),
            "src_token": port_token(F.col("src_port")), "dst_token": port_token(F.col("dst_port")),
            "protocol_token": protocol_token(F.col("protocol")),
            "total_bytes": F.coalesce(F.col("fwd_bytes"), F.lit(0.0)) + F.coalesce(F.col("bwd_bytes"), F.lit(0.0)),
        })

    def kept(self, placed: DataFrame) -> DataFrame:
        return placed.join(self.full, [*self.by, "window_id"], "left_semi")

    def edges(self, tie: list[str]) -> DataFrame:
        """Tumbling windows are columns of the scan; sliding ones repeat rows and come last."""
        coded = self.coded()
        if self.sliding:
            return self.kept(self.place(hosts.time_since_contact(coded, tie, scope=self.by)))
        return self.kept(hosts.time_since_contact(self.place(coded), tie, scope=self.by))

    def ends(self) -> DataFrame:
        """The columns that nodes are made of; no contact times, no wide rows."""
        narrow = self.coded().select(*self.by, "t", "src", "dst", "dst_token", "total_bytes", "y")
        return self.kept(self.place(narrow)).drop("window_start", "window_end")


def window_edges(
    flows: DataFrame, options: WindowOptions, tie: list[str], by: list[str] = ()
) -> DataFrame:
    """Flows with gaps, window, node ids and tokens; windows under the minimum are gone."""
    return _Placement(flows, options, by).edges(tie)


def small_windows(flows: DataFrame, options: WindowOptions, by: list[str] = ()) -> DataFrame:
    """(by, window_id, n_flows, status): windows under the minimum, which no graph has."""
    sizes = _Placement(flows, options, by).place(flows.select(*by, "t")).groupBy(*by, "window_id").agg(
        F.count(F.lit(1)).alias("n_flows")
    )
    return sizes.where(F.col("n_flows") < options.min_edges).withColumn("status", F.lit("unscored"))


def build_nodes(edges: DataFrame, by: list[str] = (), history: list[str] = ("window_id",)) -> DataFrame:
    keys = [*by, "window_id"]
    block = hosts.node_block(edges, keys).withColumn(
        "flows_now", F.col("out_degree") + F.col("in_degree")
    )
    known = hosts.host_history(block, list(history)).withColumn("is_private", is_private(F.col("host")))
    labels = hosts.node_labels(edges, keys)
    return known.join(labels, [*keys, "host"]).select(
        *keys, "host", int_to_ipv4(F.col("host")).alias("ip"),
        *[v.alias(k) for k, v in node_features().items()], "y",
        "out_degree", "in_degree",
    )


def cap_edges(edges: DataFrame, cap: int, tie: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """A repeatable sample of ``cap`` edges from each window that has more.

    Edges are thrown into hash buckets; whole buckets are kept while they fit. Only the one
    bucket that crosses the cap is ordered, and it holds a small share of a window."""
    keys = list(keys)
    buckets = 4096
    mark = F.xxhash64(*tie, F.lit(seed))
    marked = edges.withColumns({"_h": mark, "_b": F.pmod(mark, F.lit(buckets))})
    counts = marked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("_room", cap - F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # at most 4096 rows per window; a bucket that fits whole needs no order
    room = room.where(F.col("_room") > 0)
    placed = marked.join(room, [*keys, "_b"])
    whole = placed.where(F.col("_n") <= F.col("_room"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *tie))
    partial = placed.where(F.col("_n") > F.col("_room")).withColumn("_rn", rank).where(
        F.col("_rn") <= F.col("_room")
    ).drop("_rn")
    return whole.unionByName(partial).drop("_h", "_b", "_n", "_room")


def build_edges(edges: DataFrame, options: WindowOptions, ids: list[str], by: list[str] = ()) -> DataFrame:
    keys = [*by, "window_id"]
    capped = edges if options.max_edges is None else cap_edges(edges, options.max_edges, ids, keys, options.seed)
    features = edge_features(F.col("window_start"), F.col("window_end"))
    real = capped.select(
        *keys, *[F.col(c) for c in ids], "src", "dst", "src_token", "dst_token", "protocol_token",
        "y", *[v.alias(k) for k, v in features.items()], F.lit(True).alias("is_real"),
    )
    real = zero_features(real, list(options.drop_edge_features))
    if not options.add_reverse_edges:
        return real
    # both directions in one projection: the flows are read once
    ways = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("real")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("real")),
    )
    twice = real.withColumn("_w", F.explode(ways))
    return twice.withColumns({
        "src": F.col("_w.a"), "dst": F.col("_w.b"), "is_real": F.col("_w.real"),
        "direction_flag": F.when(F.col("_w.real"), F.col("direction_flag")).otherwise(0.0),
    }).drop("_w")


def build_graphs(
    flows: DataFrame, options: WindowOptions, tie: list[str], by: list[str] = (),
    history: list[str] = ("window_id",), ids: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). ``tie`` orders flows of the same second, ``ids`` (by default the same
    columns) identify a flow in the edge table. Nodes are made from a narrow table of their own,
    so neither table waits for, or pays for, the other."""
    placement = _Placement(flows, options, by)
    ends = materialize(placement.ends(), "flow-ends")
    return build_nodes(ends, by, history), build_edges(placement.edges(tie), options, ids or tie, by)


def graph_summary(nodes: DataFrame, edges: DataFrame, keys: list[str] = ("window_id",)) -> DataFrame:
    """Graph count, node and edge means and maxima, in one row."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, list(keys)).agg(
        F.count(F.lit(1)).alias("n_graphs"),
        F.avg("n_nodes").alias("nodes_mean"), F.max("n_nodes").alias("nodes_max"),
        F.avg("n_edges").alias("edges_mean"), F.max("n_edges").alias("edges_max"),
    )


def class_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, y, n) over nodes and real edges."""
    return (
        nodes.groupBy(F.lit("node").alias("kind"), "y").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(
            edges.where("is_real").groupBy(F.lit("edge").alias("kind"), "y")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    )
