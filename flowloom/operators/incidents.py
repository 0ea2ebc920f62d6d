"""Incidents, blocks, ledger states and triage."""

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.constants import KNOWN_TYPES, NON_MODEL_LABELS


def validate_labels(df: DataFrame, classes: list[str], notes: dict[str, str],
                    label: str = "attack_type") -> DataFrame:
    """Adds ``known`` and the class's reliability note; both tables are configuration."""
    spark = df.sparkSession
    rows = [(c, notes.get(c)) for c in dict.fromkeys([*classes, *NON_MODEL_LABELS])]
    table = spark.createDataFrame(rows, f"{label} string, note string").withColumn("_k", F.lit(True))
    joined = df.join(F.broadcast(table), label, "left")
    return joined.withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


# ----------------------------------------------------------------- attack type
def attack_evidence(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Per source: what the type rule reads, and an order-free digest of its targets. All
    sums are combined before the shuffle; no list of ports or targets is built."""
    from flowloom.functions.digests import target_digest

    port = F.coalesce(F.col("dst_port").cast("int"), F.lit(0))
    valid = F.when(port.between(0, 65535), port)
    packets = F.coalesce(F.col("packet_count").cast("bigint"), F.lit(0))
    volume = F.coalesce(F.col("byte_count").cast("bigint"), F.lit(0))
    target = F.concat_ws(":", F.coalesce("dst_ip", F.lit("None")), port.cast("string"))
    fine = flows.groupBy(*keys, valid.alias("_port"), target.alias("_target")).agg(
        F.max("score").alias("_score"), F.sum(F.greatest(packets, F.lit(0))).alias("_packets"),
        F.sum(F.when(port.isin(80, 443, 8080), F.greatest(volume, F.lit(0))).otherwise(0)).alias("_http"),
    )
    ports = fine.groupBy(*keys, "_port").agg(
        F.max("_score").alias("_score"), F.sum("_packets").alias("_packets"), F.sum("_http").alias("_http"),
        F.count(F.lit(1)).alias("_n"), F.sum(target_digest(F.col("_target"))).alias("_sum"),
    )
    return ports.groupBy(*keys).agg(
        F.max("_score").alias("score"), F.count("_port").alias("n_ports"),
        F.bool_or(F.coalesce(F.col("_port") == 22, F.lit(False))).alias("ssh"),
        F.sum("_packets").alias("packets"), F.sum("_http").alias("http_bytes"),
        F.sum("_n").alias("n_targets"), F.sum("_sum").alias("target_sum"),
    )


def attack_type():
    return (
        F.when(F.col("ssh") & (F.col("packets") > 250), "SSHBrute").when(F.col("n_ports") >= 5, "PortScan")
        .when(F.col("http_bytes") > 1_000_000, "DoSHulk")
        .when((F.col("packets") > 5000) | (F.col("score") >= 0.90), "DDoS").otherwise("Botnet")
    )


# ------------------------------------------------------------------- creation
def incident_candidates(flows: DataFrame, batch: str, minute: str, limits, blocked: DataFrame) -> DataFrame:
    """Sources at or over the threshold, each with type, key and, if skipped, a reason."""
    from flowloom.functions.addresses import is_enforceable
    from flowloom.functions.digests import idempotency_key
    from flowloom.functions.scoring import severity_label, severity_number

    found = attack_evidence(flows, [batch, minute, "src_ip"]).where(F.col("score") >= limits.threshold)
    known = blocked.select(F.col("ip").alias("src_ip")).distinct().withColumn("_b", F.lit(True))
    j = found.join(known, "src_ip", "left")
    reason = F.when(~is_enforceable(F.col("src_ip"), limits.cidr), "outside_range").when(F.col("_b"), "already_blocked")
    typed = j.withColumns({
        "skip_reason": reason, "attack_type": attack_type(), "severity": severity_number(F.col("score")),
    })
    key = idempotency_key(
        F.col("src_ip"), F.col("attack_type"), F.col("score"), severity_label(F.col("score")),
        F.col(minute).cast("string"), F.col("n_targets"), F.col("target_sum"),
    )
    return typed.withColumn("idempotency_key", key).drop("_b")


def new_incidents(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert-if-absent: candidates that are not skipped and whose key is not stored, each
    key once."""
    fresh = candidates.where(F.col("skip_reason").isNull()).dropDuplicates(["idempotency_key"])
    return fresh.join(existing.select("idempotency_key"), "idempotency_key", "left_anti")


def without_blocked(incidents: DataFrame, blocked: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Adds ``skip_reason`` to rows whose host is blocked already."""
    known = blocked.select(F.col("ip").alias(ip)).distinct().withColumn("_b", F.lit(True))
    return incidents.join(known, ip, "left").withColumn(
        "skip_reason", F.when(F.col("_b"), "already_blocked")
    ).drop("_b")


# -------------------------------------------------------------------- history
def healing_history(actions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Block actions with the type and score of their incident, or what the reason implies, and with
    what was measured when the block was made; what was not measured stays null."""
    i = incidents.select(
        F.col("id").alias("incident_id"), F.col("attack_type").alias("_type"), F.col("threat_score").alias("_score")
    )
    j = actions.where(F.col("action") == "block").join(i, "incident_id", "left")
    kind = (
        F.when(F.col("_type").isin(*KNOWN_TYPES), F.col("_type"))
        .when(F.col("reason").contains("MANUAL"), "Manual").when(F.col("reason").contains("GNN"), "DDoS")
        .otherwise("Unknown")
    )
    return j.withColumns({
        "attack_type": kind, "trigger_score": F.bround(F.coalesce("_score", F.lit(0.0)), 4), "action": F.lit("ISOLATED"),
    }).withColumnRenamed("status", "enforcement_status").drop("_type", "_score")


def healing_events(actions: DataFrame, incidents: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The newest healing events, at most 100: ``order`` is newest first. Only the actions that are
    shown meet the incidents."""
    newest = actions.where(F.col("action") == "block").orderBy(*[F.desc(c) for c in order]).limit(max(1, min(limit, 100)))
    return healing_history(newest, incidents).orderBy(*[F.desc(c) for c in order])


def first_incident_since(runs: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each (source_ip, since): the first captured incident at or after that time.

    Both sides meet in one ordered pass per source and hour; what is open at the end of an
    hour is answered from the first incident of a later hour, so a hot source is never one
    group."""
    hour = lambda c: F.floor(c / 3600)
    real = incidents.where(F.col("data_source") == "ovs").select(
        "source_ip", hour(F.col("created")).alias("_h"), F.col("created").alias("_t"), F.col("id").alias("_id")
    )
    runs = runs.withColumn("_run", F.struct(*runs.columns))
    keyed = runs.select("source_ip", hour(F.col("since")).alias("_h"), F.col("since").alias("_t"), "_run")
    none = F.lit(None).cast(runs.schema["_run"].dataType)
    both = real.select("source_ip", "_h", "_t", "_id", none.alias("_run")).unionByName(
        keyed.select("source_ip", "_h", "_t", F.lit(None).cast("bigint").alias("_id"), "_run")
    )
    # smallest incident id with t >= since in the rest of the hour: a running minimum from
    # the end of the hour backwards
    later = Window.partitionBy("source_ip", "_h").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_first", F.min("_id").over(later)).where(F.col("_run").isNotNull())
    hours = real.groupBy("source_ip", "_h").agg(F.min("_id").alias("_m"))
    grid = hours.unionByName(keyed.groupBy("source_ip", "_h").agg(F.lit(None).cast("bigint").alias("_m")))
    grid = grid.groupBy("source_ip", "_h").agg(F.min("_m").alias("_m"))
    after = Window.partitionBy("source_ip").orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)
    rest = grid.withColumn("_rest", F.min("_m").over(after)).select("source_ip", "_h", "_rest")
    return inside.join(rest, ["source_ip", "_h"], "left").select(
        "_run.*", F.least("_first", "_rest").alias("incident_id")
    )


# ------------------------------------------------------------------ reconcile
def installed_blocks(dump: DataFrame, text: str = "value") -> DataFrame:
    """(ip) of the drop rules a switch dump shows: priority 1000 and a drop action."""
    line = F.col(text)
    is_drop = line.contains("priority=1000") & line.contains("actions=drop")
    ip = F.regexp_extract(line, r"nw_src=([0-9.]+)", 1)
    return dump.where(is_drop).select(ip.alias("ip")).where(F.col("ip") != "").distinct()


def reconcile_plan(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """(ip, step): reapply what is wanted and absent, remove what is present and unwanted."""
    d = desired.select("ip").distinct().withColumn("_d", F.lit(True))
    o = observed.select("ip").distinct().withColumn("_o", F.lit(True))
    step = F.when(F.col("_o").isNull(), "reapply").when(F.col("_d").isNull(), "remove")
    return d.join(o, "ip", "full").select("ip", step.alias("step")).where(F.col("step").isNotNull())


# --------------------------------------------------------------------- ledger
def ledger_display_status(ledger_up: bool = True):
    """Status of an incident from its stored fields alone."""
    stored = F.col("ledger_status")
    settled = stored.isNotNull() & ~stored.isin("no_tx", "submitting")
    return (
        F.when(F.col("ledger_tx").isNull(), "no_tx").when(settled, stored)
        .otherwise(F.coalesce(stored, F.lit("pending")) if ledger_up else F.lit("unavailable"))
    )


def match_ledger(incidents: DataFrame, ledger: DataFrame, contract: str) -> DataFrame:
    """Adds ``ledger_match``: no_tx, confirmed, wrong_contract or missing."""
    from flowloom.functions.digests import with_0x

    entries = ledger.select(F.col("tx").alias("_tx"), F.lower("contract").alias("_c"), F.col("mined_ok").alias("_ok"))
    j = incidents.withColumn("_tx", with_0x(F.col("ledger_tx"))).join(entries, "_tx", "left")
    match = (
        F.when(F.col("ledger_tx").isNull(), "no_tx").when(F.col("_c").isNull(), "missing")
        .when(F.col("_c") != contract.lower(), "wrong_contract").when(F.col("_ok"), "confirmed").otherwise("missing")
    )
    return j.withColumn("ledger_match", match).drop("_tx", "_c", "_ok")


def outbox_step(incidents: DataFrame, ledger: DataFrame, now: int, limits) -> DataFrame:
    """One transition of every open row, from receipt, age and retry count.

    A sent row becomes confirmed or failed by its receipt; without one it waits, and after
    the pending limit it retries or fails for good. An unsent row is claimed for sending
    unless another writer's claim is still fresh."""
    from flowloom.functions.digests import with_0x

    entries = ledger.select(F.col("tx").alias("_tx"), F.col("mined_ok").alias("_ok"), F.col("block_number").alias("_block"))
    j = incidents.withColumn("_tx", with_0x(F.col("ledger_tx"))).join(entries, "_tx", "left")
    status = F.col("ledger_status")
    done = F.coalesce(status.isin("confirmed", "failed", "permanent_failure"), F.lit(False))
    sent = F.col("ledger_tx").isNotNull()
    since = F.coalesce("pending_since", "created")
    late = (now - since) >= limits.pending_seconds
    last_try = F.coalesce("retry_count", F.lit(0)) + 1 >= limits.max_retries
    timed_out = ~done & sent & F.col("_ok").isNull() & late
    fresh_claim = F.coalesce(status == "submitting", F.lit(False)) & ((now - since) < limits.claim_seconds)
    new = (
        F.when(done, status).when(sent & F.col("_ok"), "confirmed").when(sent & ~F.col("_ok"), "failed")
        .when(timed_out & last_try, "permanent_failure").when(timed_out, "retry").when(sent, F.coalesce(status, F.lit("pending")))
        .when(fresh_claim, status).otherwise("submitting")
    )
    return j.withColumns({
        "next_status": new,
        "next_retry_count": F.when(timed_out, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.coalesce("retry_count", F.lit(0))),
        "next_tx": F.when(timed_out & ~last_try, F.lit(None)).otherwise(F.col("ledger_tx")),
        "next_block": F.when(~done & sent, F.col("_block")),
    }).drop("_tx", "_ok", "_block")


def ledger_ids_by_host(ledger: DataFrame) -> DataFrame:
    """(source_ip, seq, incident_id) in id order: the per-host index as rows."""
    from flowloom.operators.ordered import row_ranks

    return row_ranks(ledger.select("source_ip", "incident_id"), ["source_ip"], [F.col("incident_id")], "seq")


def blocked_now(events: DataFrame) -> DataFrame:
    """(ip, blocked): the latest isolate or release of each host decides."""
    last = F.max_by("action", F.struct("t", "event_id"))
    return events.groupBy("ip").agg((last == "isolate").alias("blocked"))


# --------------------------------------------------------------------- upserts
def unblock(incidents: DataFrame, blocked: DataFrame, ip: str, at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents, blocked hosts, closing row) after a manual release of one host."""
    closed = incidents.withColumn("is_blocked", F.col("is_blocked") & (F.col("source_ip") != ip))
    rest = blocked.where(F.col("ip") != ip)
    row = incidents.sparkSession.createDataFrame([(ip, "Manual", at)], "source_ip string, attack_type string, created bigint")
    return closed, rest, row


def upsert_blocks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per host: the newest reason and score, the first time it was blocked."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("reason", "threat_score"), F.struct("_new", "blocked_at", "seq")).alias("_n")
    return both.groupBy("ip").agg(newest, F.min("blocked_at").alias("blocked_at")).select("ip", "_n.*", "blocked_at")


def triage_states(events: DataFrame) -> DataFrame:
    """Per incident from its transition log: the state now, the first acknowledgement and the
    resolution, where resolving acknowledges and reopening clears both."""
    reopened = F.max(F.when(F.col("state") == "open", F.struct("t", "seq")))
    last = events.groupBy("incident_id").agg(reopened.alias("_re"), F.max_by("state", F.struct("t", "seq")).alias("alert_status"))
    live = events.join(last, "incident_id").where(
        F.col("_re").isNull() | (F.struct("t", "seq") > F.col("_re"))
    )
    stamped = live.groupBy("incident_id").agg(
        F.min(F.when(F.col("state").isin("acknowledged", "resolved"), F.col("t"))).alias("acknowledged_at"),
        F.max(F.when(F.col("state") == "resolved", F.col("t"))).alias("_res"),
    )
    return last.drop("_re").join(stamped, "incident_id", "left").select(
        "incident_id", "alert_status", "acknowledged_at",
        F.when(F.col("alert_status") == "resolved", F.col("_res")).alias("resolved_at"),
    )


def append_log(rows: DataFrame, path: str, day: str = "day") -> None:
    """Append to an audit table, one folder per day."""
    rows.write.mode("append").partitionBy(day).parquet(path)
