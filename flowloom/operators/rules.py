"""From scored flows to mitigation rules, with a reason for every flow that gets none."""

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.constants import POLICY_ROWS, POLICY_SCHEMA
from flowloom.functions import scoring
from flowloom.operators.ordered import top_in_group
from flowloom.workspace import checked_broadcast, new_path, written_bytes


def policy_table(spark, rows=POLICY_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def flow_verdicts(edges: DataFrame, classes: list[str], probs: str = "probs") -> DataFrame:
    """Class, confidence and threat of every real flow; mirrored edges are left out."""
    p = F.col(probs)
    real = edges.where(F.col("is_real")) if "is_real" in edges.columns else edges
    pred = scoring.argmax(p)
    names = F.array(*[F.lit(c) for c in classes])
    return real.withColumns({"pred": pred, "confidence": scoring.confidence(p), "threat": scoring.threat(p)}).withColumn(
        "attack_class", F.get(names, F.col("pred"))
    )


def host_detections(nodes: DataFrame, edges: DataFrame, threshold: float, keys=("window_id",)) -> DataFrame:
    """Hosts over the threshold with their real degrees. Hosts are filtered before the join,
    and degrees are summed before it."""
    keys = list(keys)
    hot = nodes.where(F.col("threat") >= threshold)
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("host"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("host"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    ))
    degrees = edges.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.host").alias("host")).agg(
        F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")
    )
    return hot.join(degrees, [*keys, "host"], "left").fillna(0, ["out_degree", "in_degree"])


def policy_coverage(scored: DataFrame, policy: DataFrame, benign: str) -> DataFrame:
    """(attack_class, problem): predicted classes without a policy, policies no class uses."""
    seen = scored.select("attack_class").distinct().where(F.col("attack_class") != benign)
    known = policy.select("attack_class")
    a = seen.join(known, "attack_class", "left_anti").withColumn("problem", F.lit("no_policy"))
    b = known.join(seen, "attack_class", "left_anti").withColumn("problem", F.lit("never_predicted"))
    return a.unionByName(b)


def require_coverage(coverage: DataFrame) -> None:
    missing = coverage.where(F.col("problem") == "no_policy")
    total = missing.count()
    if total:
        some = [r.attack_class for r in missing.orderBy("attack_class").limit(20).collect()]
        raise ValueError(f"{total} predicted classes without a policy, among them {some}")


def with_policy(scored: DataFrame, policy: DataFrame) -> DataFrame:
    """Left lookup by class; the policy has one row per class."""
    return scored.join(F.broadcast(policy), "attack_class", "left")


def translate(
    scored: DataFrame, policy: DataFrame, tie: list[str], *, allow: DataFrame | None = None,
    corroboration: float | None = None, cap: int | None = None,
) -> DataFrame:
    """Adds ``outcome``: rule, duplicate, or why the flow is withheld.

    ``scored`` holds attack-classified flows: window_id, src_ip, dst_ip, protocol, dst_port,
    attack_class, confidence, src_threat and the tie columns. Flows count in order of falling
    confidence. One rule per key. With a ``cap`` (``MAX_RULES_PER_WINDOW`` is the usual one),
    every flow after a window's ``cap`` rules is withheld as rule_cap. The first flow of each key is found by a combined aggregate, the
    ``cap``-th such flow per window by a limited rank, and all others are compared with it.
    """
    j = with_policy(scored, policy)
    if allow is not None:
        hosts = checked_broadcast(allow.select(F.col("ip")).distinct(), "allowlist")
        j = j.join(hosts.select(F.col("ip").alias("src_ip"), F.lit(True).alias("_as")), "src_ip", "left")
        j = j.join(hosts.select(F.col("ip").alias("dst_ip"), F.lit(True).alias("_ad")), "dst_ip", "left")
        allowed = F.coalesce("_as", "_ad", F.lit(False))
    else:
        allowed = F.lit(False)
    unsure = F.col("src_threat") < corroboration if corroboration is not None else F.lit(False)
    reason = (
        F.when(F.col("action").isNull(), "no_policy").when(F.col("action") == "alert_only", "class_suppressed")
        .when(F.col("confidence") < F.col("min_conf"), "below_floor").when(allowed, "allowlisted")
        .when(unsure, "node_corroboration_absent")
    )
    order = F.struct((-F.col("confidence")).alias("_c"), *tie)
    port = F.when(F.col("action") == "drop_port", F.col("dst_port")).otherwise(F.lit(-1))
    marked = j.withColumns({"_reason": reason, "_port": port, "_order": order}).drop("_as", "_ad")
    key = ["window_id", "src_ip", "dst_ip", "protocol", "_port"]
    open_rows = marked.where(F.col("_reason").isNull())
    firsts = open_rows.groupBy(*key).agg(F.min("_order").alias("_first"))
    judged = marked.join(firsts, key, "left")
    full = F.lit(False)
    if cap is not None:
        kept = top_in_group(firsts, ["window_id"], [F.col("_first")], cap)
        limits = kept.groupBy("window_id").agg(F.count(F.lit(1)).alias("_rules"), F.max("_first").alias("_last"))
        # one row per window: sent to the flows if it is small, so that a flood window is not one key
        judged = judged.join(checked_broadcast(limits, "rule-limits"), "window_id", "left")
        full = (F.col("_rules") >= cap) & (F.col("_order") > F.col("_last"))
    outcome = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(full, "rule_cap")
        .when(F.col("_order") == F.col("_first"), "rule").otherwise("duplicate")
    )
    return judged.withColumn("outcome", outcome).drop("_reason", "_port", "_order", "_first", "_rules", "_last")


def number_rules(rules: DataFrame, tie: list[str]) -> DataFrame:
    """Adds ``cookie``, the rule's number in its window; a window has at most ``cap`` rules."""
    order = Window.partitionBy("window_id").orderBy(F.desc("confidence"), *tie)
    return rules.where(F.col("outcome") == "rule").withColumn("cookie", F.row_number().over(order))


def render_rules(rules: DataFrame, bridge: str = "br0") -> DataFrame:
    """Adds the OpenFlow match and instruction as structs, and a command text. Text only:
    nothing is sent anywhere."""
    port_ok = F.col("protocol").isin(6, 17) & (F.col("dst_port") > 0)
    drops = F.col("action").isin("drop", "drop_port", "drop_and_quarantine")
    match = F.struct(
        F.lit(0x0800).alias("eth_type"), F.col("src_ip").alias("ipv4_src"), F.col("dst_ip").alias("ipv4_dst"),
        F.col("protocol").alias("ip_proto"),
        F.when(port_ok & (F.col("protocol") == 6), F.col("dst_port")).alias("tcp_dst"),
        F.when(port_ok & (F.col("protocol") == 17), F.col("dst_port")).alias("udp_dst"),
    )
    kind = F.when(drops, F.lit(None)).when(F.col("action") == "meter", "METER").otherwise("OUTPUT_NORMAL")
    instruction = F.struct(kind.alias("type"), F.when(F.col("action") == "meter", F.col("cookie")).alias("meter_id"))
    names = F.create_map(F.lit(6), F.lit("tcp"), F.lit(17), F.lit("udp"), F.lit(1), F.lit("icmp"))
    parts = F.concat_ws(
        ",", F.format_string("priority=%d", "priority"), F.coalesce(names[F.col("protocol")], F.lit("ip")),
        F.concat(F.lit("nw_src="), "src_ip"), F.concat(F.lit("nw_dst="), "dst_ip"),
        F.when(port_ok, F.format_string("tp_dst=%d", F.col("dst_port").cast("int"))),
        F.format_string("idle_timeout=%d", "idle"), F.format_string("hard_timeout=%d", "hard"),
    )
    verb = F.when(F.col("action").startswith("drop"), "drop").otherwise("normal")
    command = F.concat(F.lit(f'ovs-ofctl add-flow {bridge} "'), parts, F.lit(",actions="), verb, F.lit('"'))
    return rules.withColumns({"match": match, "instruction": instruction, "command": command})


def accept_echo(rules: DataFrame, digest: str) -> DataFrame:
    """Keep only rules made under the expected policy and marked dry-run."""
    ok = (F.col("policy_digest") == digest) & F.col("dry_run")
    return rules.withColumn("accepted", F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- ground truth
FIVE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def true_labels(flows: DataFrame, key: list[str] = FIVE) -> DataFrame:
    """(key, y) for keys with exactly one label. Two extremes decide it, no set is built."""
    rolled = flows.groupBy(*key).agg(F.min("y").alias("y"), F.max("y").alias("_hi"))
    return rolled.where(F.col("y") == F.col("_hi")).drop("_hi")


def rule_check(verdicts: DataFrame, truth: DataFrame, floors: DataFrame, key: list[str] = FIVE) -> DataFrame:
    """Per (true class, predicted class): count, right ones, median confidence, right ones at
    the floor. ``floors`` (pred, floor) has one row per class."""
    from flowloom.operators.ordered import exact_percentiles

    j = verdicts.drop("y").join(truth, key).join(F.broadcast(floors), "pred", "left")
    right = F.col("y") == F.col("pred")
    counts = j.groupBy("y", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"),
        F.count_if(right & (F.col("confidence") >= F.col("floor"))).alias("correct_at_floor"),
    )
    mid = exact_percentiles(j, ["y", "pred"], ["confidence"], [0.5]).select("y", "pred", F.col("value").alias("median_confidence"))
    return counts.join(mid, ["y", "pred"])


HEAVY = 200_000  # edges of a host in a window from which it is not joined by shuffle
SMALL = 32 << 20  # bytes of node rows that are sent to every task


def tabular_rows(edges: DataFrame, nodes: DataFrame, edge_features: list[str], node_features: list[str],
                 keys=("window_id",), ids: list[str] = ()) -> DataFrame:
    """Edge features with those of both ends: 20 + 2 x 16 columns.

    Node rows are written once for both ends. If they are small, they are sent to every task.
    Otherwise the hosts with ``HEAVY`` edges or more in a window, of which there are few, are sent, and
    only the edges of the others are joined by shuffle; a heavy host's edges stay spread."""
    spark = edges.sparkSession
    keys = list(keys)
    path = new_path(spark, "tabular-nodes")
    nodes.select(*keys, "host", *node_features).write.parquet(path)
    known = spark.read.parquet(path)
    small = written_bytes(spark, path) <= SMALL
    rows = edges.select(*keys, *ids, "src", "dst", "y", *edge_features)
    order = list(rows.columns)
    for end in ("src", "dst"):
        named = {f: f"{end}_{f}" for f in node_features}
        side = known.select(*keys, F.col("host").alias(end), *[F.col(f).alias(n) for f, n in named.items()])
        rows = rows.join(F.broadcast(side), [*keys, end]) if small else _join_apart(rows, side, keys, end, list(named.values()))
        order += named.values()
    return rows.select(*order)


def _join_apart(rows: DataFrame, side: DataFrame, keys: list[str], end: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of their end, heavy ends through a broadcast. What was found there goes
    through the shuffle under a spread key that no host has."""
    counts = rows.groupBy(*keys, end).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HEAVY).drop("_n")
    heavy = checked_broadcast(
        side.join(counts, [*keys, end]).select(*keys, end, F.struct(*columns).alias("_heavy")), "heavy-hosts"
    )
    spread = -1 - F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(4096))
    met = rows.join(heavy, [*keys, end], "left").withColumn("_slot", F.when(F.col("_heavy").isNull(), F.col(end)).otherwise(spread))
    others = side.select(*keys, F.col(end).alias("_slot"), F.struct(*columns).alias("_other"))
    found = met.join(others, [*keys, "_slot"], "left").withColumn("_end", F.coalesce("_heavy", "_other"))
    return found.where(F.col("_end").isNotNull()).select(*rows.columns, *[F.col(f"_end.{c}").alias(c) for c in columns])
