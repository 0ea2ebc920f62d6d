"""The driver tables seen as flows, live records, alerts, ledgers and score sets.

Every view is written twice: as a DataFrame and as a DuckDB common table expression.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.session import tune
from flowloom.workspace import new_path

TIE = ["k1", "k2", "k3", "k4", "k5"]
SEQ = ["seq"]  # one number that orders flows of the same second
CLASSES = ["BENIGN", "DDoS", "PortScan", "Botnet", "SSHBrute", "DoSHulk"]
WEEK = 604800


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _epoch(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


STAGED: dict[tuple, str] = {}


def staged(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived table, written once per application as a user would keep it."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in STAGED:
        path = new_path(spark, name)
        build(spark, sf).write.parquet(path)
        STAGED[key] = path
    return spark.read.parquet(STAGED[key])


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flow records with ties, features, label and class index."""
    return staged(spark, sf, "flows", _flows)


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rem = F.col("l_partkey") % 8
    y = F.when(F.col("l_quantity") <= 35, 0).otherwise((F.col("l_suppkey") % 5 + 1).cast("int"))
    line = F.col("l_linenumber").cast("double")
    base = joined.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("bigint").alias("k2"),
        F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.col("l_extendedprice").alias("k5"),
        F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 64 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 64 + 1).cast("string")).alias("dst_ip"),
        (F.col("l_orderkey") % 60000 + 1024).alias("src_port"),
        F.when(rem == 0, 22).when(rem == 1, 80).when(rem == 2, 443).when(rem == 3, 53)
        .when(rem == 4, 8080).otherwise(F.col("l_partkey")).cast("bigint").alias("dst_port"),
        F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17)
        .otherwise(1).alias("protocol"),
        _epoch("l_shipdate").alias("t"),
        (line * 1e6).alias("duration_us"),
        F.col("l_quantity").alias("fwd_packets"),
        F.floor(F.col("l_quantity") * F.col("l_tax") * 10).cast("double").alias("bwd_packets"),
        F.col("l_extendedprice").alias("fwd_bytes"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("bwd_bytes"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fwd_len_max"),
        (F.col("l_discount") * 1000).alias("bwd_len_max"),
        (line * 1000).alias("iat_mean"), (line * 2000).alias("fwd_iat"),
        (F.col("l_tax") * 10000).alias("bwd_iat"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("syn"),
        F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0).alias("rst"),
        F.lit(1.0).alias("ack"), F.lit(0.0).alias("psh"),
        (F.col("l_extendedprice") / line).alias("bytes_per_s"),
        (F.col("l_quantity") / line).alias("packets_per_s"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("seq"),
        y.alias("y"), F.year("l_shipdate").cast("string").alias("source_file"),
    )
    label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("y") + 1)
    return base.withColumn("label", label)


FLOWS = """flows AS (
  SELECT *, CASE y WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'PortScan'
    WHEN 3 THEN 'Botnet' WHEN 4 THEN 'SSHBrute' ELSE 'DoSHulk' END AS label FROM (
  SELECT l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4,
    l_extendedprice AS k5,
    '10.0.0.' || CAST(o_custkey % 64 + 1 AS VARCHAR) AS src_ip,
    '10.0.0.' || CAST(l_suppkey % 64 + 1 AS VARCHAR) AS dst_ip,
    l_orderkey % 60000 + 1024 AS src_port,
    CAST(CASE l_partkey % 8 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53
      WHEN 4 THEN 8080 ELSE l_partkey END AS BIGINT) AS dst_port,
    CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS protocol,
    CAST(epoch(l_shipdate) AS BIGINT) AS t,
    l_linenumber * 1e6 AS duration_us, l_quantity AS fwd_packets,
    CAST(floor(l_quantity * l_tax * 10) AS DOUBLE) AS bwd_packets,
    l_extendedprice AS fwd_bytes, l_extendedprice * l_tax AS bwd_bytes,
    l_extendedprice / l_quantity AS fwd_len_max, l_discount * 1000 AS bwd_len_max,
    CAST(l_linenumber AS DOUBLE) * 1000 AS iat_mean, CAST(l_linenumber AS DOUBLE) * 2000 AS fwd_iat,
    l_tax * 10000 AS bwd_iat,
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS syn,
    CASE WHEN l_quantity > 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rst,
    1.0::DOUBLE AS ack, 0.0::DOUBLE AS psh,
    l_extendedprice / CAST(l_linenumber AS DOUBLE) AS bytes_per_s,
    l_quantity / CAST(l_linenumber AS DOUBLE) AS packets_per_s,
    (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey * 7 + l_suppkey AS seq,
    CASE WHEN l_quantity <= 35 THEN 0 ELSE CAST(l_suppkey % 5 + 1 AS INTEGER) END AS y,
    CAST(year(l_shipdate) AS VARCHAR) AS source_file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).where(F.col("src_ip") != F.col("dst_ip"))


CLEAN = FLOWS + ",\nclean AS (SELECT * FROM flows WHERE src_ip <> dst_ip)"


def windowed(spark: SparkSession, sf: str, seconds: int = WEEK) -> DataFrame:
    """Cleaned flows with src/dst ids, token, bytes and a weekly window."""
    from flowloom.functions.addresses import ipv4_to_int
    from flowloom.functions.ports import port_token
    from flowloom.operators.hosts import assign_windows

    return assign_windows(clean(spark, sf), seconds).withColumns({
        "src": ipv4_to_int(F.col("src_ip")), "dst": ipv4_to_int(F.col("dst_ip")),
        "dst_token": port_token(F.col("dst_port")),
        "total_bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
    })


def ip_int_sql(ip: str) -> str:
    part = lambda i: f"CAST(split_part({ip}, '.', {i}) AS BIGINT)"
    return f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"


def token_sql(port: str) -> str:
    from flowloom.constants import NAMED_PORTS, PORT_BUCKET_EDGES

    named = " ".join(f"WHEN {p} THEN {i + 2}" for i, p in enumerate(NAMED_PORTS))
    base = 2 + len(NAMED_PORTS)
    steps = " + ".join(f"({port} >= {e})::INT" for e in PORT_BUCKET_EDGES[1:-1])
    return (f"(CASE WHEN {port} IS NULL OR {port} < 0 OR {port} > 65535 THEN 1 ELSE "
            f"CASE {port} {named} ELSE {base} + {steps} END END)")


def windowed_sql(seconds: int = WEEK) -> str:
    return CLEAN + f""",
win AS (SELECT *, CAST(floor((t - (SELECT min(t) FROM clean)) / {seconds}) AS BIGINT) AS window_id,
  {ip_int_sql('src_ip')} AS src, {ip_int_sql('dst_ip')} AS dst, {token_sql('dst_port')} AS dst_token,
  fwd_bytes + bwd_bytes AS total_bytes FROM clean),
wt0 AS (SELECT min(t) AS t0 FROM clean)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with six class probabilities from fixed arithmetic on the keys, a view of few columns
    of the flows: it is not written a second time."""
    def weight(k):
        mixed = (F.col("k1") * (k + 3) + F.col("k2") * 7 + F.col("k3") * (k * 2 + 1)) % 97
        return F.lit(1.0) + mixed + F.when(F.col("y") == k, 60.0).otherwise(0.0)

    rows = windowed(spark, sf).withColumns({f"_w{k}": weight(k) for k in range(6)})
    rows = rows.withColumn("ws", sum((F.col(f"_w{k}") for k in range(6)), F.lit(0.0)))
    probs = F.array(*[F.col(f"_w{k}") / F.col("ws") for k in range(6)])
    return rows.withColumn("probs", probs).drop("ws", *[f"_w{k}" for k in range(6)])


def scored_sql() -> str:
    w = lambda k: (f"(1.0::DOUBLE + ((k1 * {k + 3} + k2 * 7 + k3 * {2 * k + 1}) % 97) + "
                   f"CASE WHEN y = {k} THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END)")
    cols = ", ".join(f"{w(k)} AS w{k}" for k in range(6))
    probs = ", ".join(f"w{k} / ws AS p{k}" for k in range(6))
    pred = "CASE " + " ".join(f"WHEN p{k} = pm THEN {k}" for k in range(6)) + " END"
    return windowed_sql() + f""",
sw AS (SELECT *, {cols} FROM win),
sp AS (SELECT * EXCLUDE (w0, w1, w2, w3, w4, w5, ws), {probs} FROM (SELECT *, w0+w1+w2+w3+w4+w5 AS ws FROM sw)),
scored AS (SELECT *, {pred} AS pred, pm AS conf, 1.0::DOUBLE - p0 AS threat FROM
  (SELECT *, greatest(p0,p1,p2,p3,p4,p5) AS pm FROM sp))"""


def live(spark: SparkSession, sf: str) -> DataFrame:
    """Live flow records; the polling batch is the day of the flow."""
    f = flows(spark, sf)
    return f.select(
        *TIE, "t", "src_ip", "dst_ip", F.col("src_port").cast("int").alias("src_port"),
        F.col("dst_port").cast("int").alias("dst_port"),
        F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "UDP").otherwise("ICMP").alias("protocol"),
        (F.col("fwd_packets") * 200).cast("bigint").alias("packet_count"),
        F.floor(F.col("fwd_bytes") * 100).cast("bigint").alias("byte_count"),
        (F.col("duration_us") / 1e6).alias("duration_sec"),
        (F.col("k1") % 32).cast("int").alias("tcp_flags"),
        F.when(F.col("k1") % 11 == 0, F.lit(None)).when(F.col("k1") % 7 == 0, "demo").otherwise("ovs").alias("data_source"),
        F.col("t").alias("batch_id"),
    )


LIVE = FLOWS + """,
live AS (SELECT k1,k2,k3,k4,k5,t,src_ip,dst_ip, CAST(src_port AS INT) AS src_port, CAST(dst_port AS INT) AS dst_port,
  CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CAST(fwd_packets * 200 AS BIGINT) AS packet_count, CAST(floor(fwd_bytes * 100) AS BIGINT) AS byte_count,
  duration_us / 1e6 AS duration_sec, CAST(k1 % 32 AS INT) AS tcp_flags,
  CASE WHEN k1 % 11 = 0 THEN NULL WHEN k1 % 7 = 0 THEN 'demo' ELSE 'ovs' END AS data_source, t AS batch_id FROM flows)"""

HEURISTIC_SQL = """round_even(least(0.04::DOUBLE + least(packet_count / 15000.0::DOUBLE, 0.42::DOUBLE)
  + least(byte_count / greatest(duration_sec, 0.001::DOUBLE) / 8000000.0::DOUBLE, 0.28::DOUBLE)
  + CASE WHEN dst_port IN (22,23,80,443,8080) THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN tcp_flags & 2 > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN packet_count > 5000 AND duration_sec < 5 THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END, 0.98::DOUBLE), 4)"""
LIVE_SCORED = LIVE + f",\nls AS (SELECT *, {HEURISTIC_SQL} AS score FROM live)"


def live_scored(spark: SparkSession, sf: str) -> DataFrame:
    from flowloom.functions.scoring import heuristic_score

    return live(spark, sf).withColumn("score", heuristic_score())


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as incidents: source, type, score, triage and ledger columns."""
    o = table(spark, sf, "orders")
    kinds = F.array(*[F.lit(x) for x in ["DDoS", "PortScan", "SSHBrute", "Botnet", "DoSHulk", "Manual", "Odd"]])
    score = (F.col("o_orderkey") * 37 % 1000) / F.lit(1000.0)
    t = _epoch("o_orderdate") + F.col("o_orderkey") * 7919 % 86400
    h = F.col("o_orderkey") % 9
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 64 + 1).cast("string")).alias("source_ip"),
        F.element_at(kinds, (F.col("o_custkey") % 7 + 1).cast("int")).alias("attack_type"),
        score.alias("threat_score"),
        ((F.col("o_orderkey") % 3) == 0).alias("is_blocked"),
        t.alias("created"), F.timestamp_seconds(t).alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "acknowledged")
        .otherwise("open").alias("alert_status"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_seconds(t + F.col("o_orderkey") % 5000 - 100)).alias("acknowledged_at"),
        F.when(h > 2, F.concat(F.when(h % 2 == 0, "0x").otherwise(""), F.md5(F.col("o_orderkey").cast("string")))).alias("ledger_tx"),
        F.when(h == 3, "confirmed").when(h == 4, "failed").when(h == 5, "submitting")
        .when(h == 6, "pending").when(h == 7, F.lit(None)).otherwise("no_tx").alias("ledger_status"),
        (F.col("o_orderkey") % 6).cast("int").alias("retry_count"),
        (t + F.col("o_orderkey") % 400).alias("pending_since"),
        F.when(h == 1, "simulation").when(h == 2, "manual").otherwise("ovs").alias("data_source"),
    )


INCIDENTS = """inc AS (SELECT *, make_timestamp(created * 1000000) AS created_at,
  CASE WHEN st <> 'O' THEN make_timestamp((created + id % 5000 - 100) * 1000000) END AS acknowledged_at FROM (
  SELECT o_orderkey AS id, o_orderstatus AS st, '10.0.0.' || CAST(o_custkey % 64 + 1 AS VARCHAR) AS source_ip,
  ['DDoS','PortScan','SSHBrute','Botnet','DoSHulk','Manual','Odd'][o_custkey % 7 + 1] AS attack_type,
  (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS threat_score, o_orderkey % 3 = 0 AS is_blocked,
  CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 AS created,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END AS alert_status,
  CASE WHEN o_orderkey % 9 > 2 THEN CASE WHEN o_orderkey % 9 % 2 = 0 THEN '0x' ELSE '' END || md5(CAST(o_orderkey AS VARCHAR)) END AS ledger_tx,
  CASE o_orderkey % 9 WHEN 3 THEN 'confirmed' WHEN 4 THEN 'failed' WHEN 5 THEN 'submitting' WHEN 6 THEN 'pending'
    WHEN 7 THEN NULL ELSE 'no_tx' END AS ledger_status,
  CAST(o_orderkey % 6 AS INT) AS retry_count,
  CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 + o_orderkey % 400 AS pending_since,
  CASE o_orderkey % 9 WHEN 1 THEN 'simulation' WHEN 2 THEN 'manual' ELSE 'ovs' END AS data_source
  FROM orders))"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger entries of two thirds of the incidents; some call a wrong contract."""
    i = incidents(spark, sf).where((F.col("id") % 9 > 2) & (F.col("id") % 4 != 0))
    return i.select(
        F.col("id").alias("incident_id"), F.concat(F.lit("0x"), F.md5(F.col("id").cast("string"))).alias("tx"),
        F.when(F.col("id") % 5 == 0, "0xbeef").otherwise("0xCAFE").alias("contract"),
        (F.col("id") % 10 != 7).alias("mined_ok"), (F.col("id") * 3).alias("block_number"),
        "source_ip", "attack_type", F.col("created").alias("t"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 50000 + 21000).alias("gas_used"),
    )


LEDGER = INCIDENTS + """,
led AS (SELECT id AS incident_id, '0x' || md5(CAST(id AS VARCHAR)) AS tx,
  CASE WHEN id % 5 = 0 THEN '0xbeef' ELSE '0xCAFE' END AS contract, id % 10 <> 7 AS mined_ok, id * 3 AS block_number,
  source_ip, attack_type, created AS t, CASE WHEN id % 13 <> 0 THEN id % 50000 + 21000 END AS gas_used
  FROM inc WHERE id % 9 > 2 AND id % 4 <> 0)"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as enforcement actions on incidents."""
    items = table(spark, sf, "lineitem")
    t = _epoch("l_shipdate") + F.col("l_orderkey") * 31 % 86400
    kind = F.col("l_linenumber") % 4
    return items.select(
        F.col("l_orderkey").alias("incident_ref"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_extendedprice").alias("k5"),
        F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 64 + 1).cast("string")).alias("ip_address"),
        F.when(kind == 3, "unblock").otherwise("block").alias("action"),
        F.when(kind == 0, "GNN_DETECTED").when(kind == 1, "MANUAL_OVERRIDE").when(kind == 2, "RECONCILE_REAPPLY")
        .otherwise("MANUAL_OVERRIDE").alias("reason"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_orderkey")).alias("incident_id"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("duration_ms"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_orderkey") % 40).alias("edges_severed"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount").cast("double")).alias("network_stability_before"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax").cast("double")).alias("network_stability_after"),
        F.when(F.col("l_linestatus") == "F", "applied").otherwise("pending").alias("status"),
        t.alias("created"),
    )


ACTIONS = """act AS (SELECT l_orderkey AS incident_ref, l_linenumber AS line, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5,
  '10.0.0.' || CAST(l_suppkey % 64 + 1 AS VARCHAR) AS ip_address,
  CASE WHEN l_linenumber % 4 = 3 THEN 'unblock' ELSE 'block' END AS action,
  CASE l_linenumber % 4 WHEN 0 THEN 'GNN_DETECTED' WHEN 2 THEN 'RECONCILE_REAPPLY' ELSE 'MANUAL_OVERRIDE' END AS reason,
  CASE WHEN l_partkey % 3 <> 0 THEN l_orderkey END AS incident_id,
  CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS duration_ms,
  CASE WHEN l_partkey % 5 <> 0 THEN l_orderkey % 40 END AS edges_severed,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_discount AS DOUBLE) END AS network_stability_before,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_tax AS DOUBLE) END AS network_stability_after,
  CASE WHEN l_linestatus = 'F' THEN 'applied' ELSE 'pending' END AS status,
  CAST(epoch(l_shipdate) AS BIGINT) + l_orderkey * 31 % 86400 AS created FROM lineitem)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
