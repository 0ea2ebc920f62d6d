"""Reports on splits, clocks, labels and distributions."""

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.clock import has_meridiem, parse_timestamps, repair_clock
from flowloom.operators.ordered import exact_percentiles
from flowloom.workspace import checked_broadcast


def window_company(df: DataFrame, min_edges: int, keys: list[str] = ("window_id",)) -> DataFrame:
    """Adds whether a row's window holds benign rows, and whether it is large enough. Window
    counts are aggregated and sent to the rows; the window's rows never meet in one task."""
    counts = checked_broadcast(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 0).alias("_benign")),
        "window-company",
    )
    joined = df.join(counts, list(keys))
    return joined.withColumns({
        "shares_with_benign": F.col("_benign") > 0, "graphable": F.col("_n") >= min_edges,
    }).drop("_n", "_benign")


def split_summary(df: DataFrame, min_edges: int, label: str = "label") -> DataFrame:
    rows = window_company(df, min_edges)
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.count_distinct("window_id").alias("windows"),
        F.count_if("graphable").alias("graphable_rows"),
        F.count_if("shares_with_benign").alias("sharing_rows"),
        F.count_distinct("source_file").alias("n_files"),
    )


def rows_per_file(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label, "source_file").agg(F.count(F.lit(1)).alias("n"))


def purged_rows(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    a = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    joined = a.join(b, label, "full").fillna(0)
    return joined.withColumn("purged", F.col("n_before") - F.col("n_after"))


def boundary_sharing(df: DataFrame, label: str = "label") -> DataFrame:
    """Timestamps that adjacent splits share per class, and the rows on them."""
    counts = df.groupBy(label, "t").agg(*[
        F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")
    ])
    pairs = F.explode(F.array(
        F.struct(F.lit("train|val").alias("boundary"), F.col("train").alias("l"), F.col("val").alias("r")),
        F.struct(F.lit("val|test").alias("boundary"), F.col("val").alias("l"), F.col("test").alias("r")),
    ))
    shared = counts.select(label, pairs.alias("p")).select(label, "p.*").where("l > 0 AND r > 0")
    return shared.groupBy(label, "boundary").agg(
        F.count(F.lit(1)).alias("shared_times"), F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")
    )


def time_resolution(df: DataFrame, file: str = "source_file", t: str = "t") -> DataFrame:
    second = F.col(t) % 60
    return df.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(second != 0).alias("off_minute"),
        F.count_distinct(second).alias("distinct_seconds"),
    )


def clock_audit(df: DataFrame, raw: str = "timestamp", file: str = "source_file",
                pm_hours: tuple = (1, 7)) -> DataFrame:
    """Per file and day: what the clock repair saw and did."""
    parsed = parse_timestamps(df, raw, "_before").withColumn("_ts", F.col("_before"))
    fixed = repair_clock(parsed, "_ts", raw, pm_hours).where(F.col("_before").isNotNull())
    hour = F.hour("_before")
    late, afternoon = hour >= 13, hour.between(*pm_hours)
    return fixed.groupBy(file, F.to_date("_before").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(late).alias("hour_ge_13"),
        F.count_if(afternoon).alias("pm_window_rows"),
        F.count_if(has_meridiem(F.col(raw))).alias("am_pm_tokens"),
        F.count_if("moved").alias("moved_rows"), (F.bool_or(late) & F.bool_or(afternoon)).alias("mixed"),
    )


def clock_verdicts(audit: DataFrame, file: str = "source_file") -> DataFrame:
    rolled = audit.groupBy(file).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("moved_rows").alias("moved_rows"),
        F.count_if("mixed").alias("mixed_days"),
    )
    verdict = F.when(F.col("mixed_days") > 0, "MIXED").when(F.col("moved_rows") > 0, "REPAIRED").otherwise("CLEAN")
    return rolled.withColumn("verdict", verdict)


def feature_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) over the given rows; population deviation."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ]))
    return df.select(cells.alias("c")).groupBy(F.col("c.column").alias("column")).agg(
        F.avg("c.v").alias("mean"), F.stddev_pop("c.v").alias("std")
    )


def standardise(df: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """z-scores with the training rows' moments, which are one row."""
    stats = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(df.columns)


def mixed_windows(df: DataFrame, min_flows: int = 8) -> DataFrame:
    """Windows in all, and windows of enough flows that hold both benign and attack rows."""
    per = df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("b"))
    mixed = (F.col("n") >= min_flows) & (F.col("b") > 0) & (F.col("b") < F.col("n"))
    return per.agg(F.count(F.lit(1)).alias("windows"), F.count_if(mixed).alias("mixed"))


def label_bursts(df: DataFrame, keys: list[str], gap: int = 600, t: str = "t") -> DataFrame:
    """(keys, n_rows, bursts): a burst ends when a label is silent for longer than the gap.
    The lag runs over distinct seconds of a label in a file."""
    seconds = df.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(order) > gap).cast("int"), F.lit(1))
    return seconds.withColumn("_new", new).groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("_new").alias("bursts")
    )


def taxonomy_audit(bursts: DataFrame, taxonomy: DataFrame, raw: str = "label") -> DataFrame:
    """Burst and row counts rolled up per taxonomy class; a raw label no map knows keeps its
    own row with ``class`` null. ``taxonomy`` is the small label table."""
    table = taxonomy.select("taxonomy", F.col("raw_label").alias(raw), F.col("label").alias("class"))
    names = table.select("taxonomy").distinct()
    every = bursts.crossJoin(F.broadcast(names))
    joined = every.join(F.broadcast(table), ["taxonomy", raw], "left")
    dropped = F.when(F.col("class").isNull(), F.col(raw))
    return joined.groupBy("taxonomy", "class", dropped.alias("dropped_label")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("bursts").alias("bursts")
    )


def missing_categories(bursts: DataFrame, required: list[str], raw: str = "label") -> DataFrame:
    want = bursts.sparkSession.createDataFrame([(x,) for x in required], f"{raw} string")
    return want.join(bursts.select(raw).distinct(), raw, "left_anti")


def topology_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: flows, distinct ends and ports, and the source with most flows (the smaller
    address on a tie)."""
    wide = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_flows"), F.count_distinct("src_ip").alias("n_src"),
        F.count_distinct("dst_ip").alias("n_dst"), F.count_distinct("dst_port").alias("n_ports"),
    )
    per = df.groupBy(label, "src_ip").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy(label).agg(F.max("n").alias("n"))
    top = per.join(most, [label, "n"]).groupBy(label).agg(F.min("src_ip").alias("top_source"))
    return wide.join(top, label)


def box_statistics(df: DataFrame, keys: list[str], columns: list[str], min_rows: int = 1) -> DataFrame:
    """(keys, column, n, low, q1, median, q3, high) for groups with enough rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    q = exact_percentiles(df, keys, columns, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    wide = q.groupBy(*keys, "column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()
    ])
    return wide.join(sizes, keys)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every pair, all from one aggregate row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ]))
    return row.select(cells.alias("p")).select("p.*")


def capped_histogram(df: DataFrame, column: str, bins: int = 50, cap: float = 0.99) -> DataFrame:
    """Counts in equal bins between 0 and the cap quantile; larger values are left out."""
    top = exact_percentiles(df, [], [column], [cap]).select(F.col("value").alias("_cap"))
    rows = df.select(F.col(column).cast("double").alias("_v")).crossJoin(F.broadcast(top))
    bucket = F.least(F.floor(F.col("_v") / F.col("_cap") * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col("_v") <= F.col("_cap")).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def claim_check(computed: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, computed, expected, verdict): PASS, FAIL or NO DATA."""
    both = computed.join(expected, keys, "full")
    off = F.abs(F.col("computed") - F.col("expected")) > tolerance
    verdict = F.when(F.col("computed").isNull(), "NO DATA").when(F.col("expected").isNull() | off, "FAIL").otherwise("PASS")
    return both.withColumn("verdict", verdict)
