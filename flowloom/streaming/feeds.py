"""Live scoring, enrichment, duplicate suppression and health of the feeds."""

from typing import Callable

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.scoring import heuristic_score
from flowloom.operators import incidents as inc, views
from flowloom.settings import ServiceLimits


def enrich(stream: DataFrame, policy: DataFrame | None = None, allow: DataFrame | None = None,
           blocked: DataFrame | None = None) -> DataFrame:
    """Stream-static joins: policy by class, allowlist and blocked flags by source."""
    out = stream
    if policy is not None:
        out = out.join(F.broadcast(policy), "attack_class", "left")
    for name, table in (("allowlisted", allow), ("blocked", blocked)):
        if table is not None:
            flags = table.select(F.col("ip").alias("src_ip")).distinct().withColumn(name, F.lit(True))
            out = out.join(flags, "src_ip", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def once_per_key(stream: DataFrame, key: str, at: str, delay: str = "2 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def score_batch(flows: DataFrame, blocked: DataFrame, existing: DataFrame, order: list[str],
                limits: ServiceLimits = ServiceLimits()) -> dict[str, DataFrame]:
    """All tables one poll refreshes. An empty poll gives empty tables and the host list."""
    scored = flows.withColumns({"score": heuristic_score(), "minute": F.floor(F.col("t") / 60)})
    scores = views.ip_scores(scored)
    candidates = inc.incident_candidates(scored, "batch_id", "minute", limits, blocked)
    hosts = views.host_table(scored, scores, blocked, order)
    return {
        "incidents": inc.new_incidents(candidates, existing), "skipped": candidates.where(F.col("skip_reason").isNotNull()),
        "hosts": hosts, "links": views.link_table(scored, scores, order), "stats": views.dashboard_stats(hosts, scored),
    }


def poll_writer(root: str, blocked: Callable[[], DataFrame], existing: Callable[[], DataFrame], order: list[str],
                limits: ServiceLimits = ServiceLimits()):
    """A ``foreachBatch`` function that refreshes every table of a poll, per batch id."""
    def write(flows: DataFrame, batch: int) -> None:
        rows = flows.persist()
        try:
            for name, table in score_batch(rows, blocked(), existing(), order, limits).items():
                table.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        finally:
            rows.unpersist()

    return write


# ----------------------------------------------------------------------- health
def component_health(components: DataFrame) -> DataFrame:
    """One row: ok when all are, down when a required one is, degraded otherwise."""
    bad = F.col("status") != "ok"
    overall = F.when(F.bool_or(bad & F.col("required")), "down").when(F.bool_or(bad), "degraded").otherwise("ok")
    return components.agg(overall.alias("status"), F.count_if(bad).alias("n_not_ok"))


def source_health(polls: DataFrame) -> DataFrame:
    """Per source: polls by status, last success, and failures since. Two aggregates: the
    failures in a row are those later than the last success."""
    ok = F.col("status").startswith("ok")
    last = polls.groupBy("source").agg(F.max(F.when(ok, F.col("t"))).alias("last_success"))
    since = ~ok & (F.col("last_success").isNull() | (F.col("t") > F.col("last_success")))
    return polls.join(last, "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("polls"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "ok_empty").alias("ok_empty"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("last_success").alias("last_success"), F.count_if(since).alias("consecutive_failures"),
    )


def refusal_episodes(polls: DataFrame) -> DataFrame:
    """Runs of refused polls per source: start, end of the refusal, polls and flows refused.
    One row per poll comes in; a source's polls are bounded by the poll interval."""
    order = Window.partitionBy("source").orderBy("t")
    refused = F.col("state") == "refused"
    new = (refused & ~F.coalesce(F.lag("state").over(order) == "refused", F.lit(False))).cast("int")
    marked = polls.withColumns({"_new": new, "_next": F.lead("t").over(order)})
    run = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(refused).groupBy("source", "_run").agg(
        F.min("t").alias("since"), F.max(F.coalesce("_next", "t")).alias("until"), F.count(F.lit(1)).alias("polls"),
        F.sum("n_flows").alias("flows"),
    ).withColumn("seconds", F.col("until") - F.col("since")).drop("_run")
