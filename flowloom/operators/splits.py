"""Train / validation / test protocols.

A protocol becomes a small plan of time bounds, one row per class (or one row in all). It is
computed from the histogram of flows per class and second, then applied to the flows by a
comparison. Only the flows of a second that a cut falls into need a rank.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.operators.ordered import exact_percentiles, rank_segments, row_ranks, running_totals
from flowloom.settings import SplitOptions

FAR = (1 << 62)


def adaptive_gap(span: Column, requested: int, max_frac: float = 0.05) -> Column:
    """The dead zone, at most a share of the span and at least one second."""
    return F.least(F.lit(requested), F.greatest(span * max_frac, F.lit(1.0)).cast("bigint")).cast("bigint")


def episodes(df: DataFrame, by: list[str], gap: int, t: str = "t") -> DataFrame:
    """(by, t, n, episode) over distinct seconds: a silence longer than ``gap`` starts a new
    episode. Group size is bounded by the seconds of the capture."""
    seconds = df.groupBy(*by, t).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(t)
    starts = (F.col(t) - F.lag(t).over(order) > gap).cast("bigint")
    flagged = seconds.withColumn("_new", F.coalesce(starts, F.lit(0)))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("episode", F.sum("_new").over(running)).drop("_new")


def rank_plan(df: DataFrame, by: list[str], options: SplitOptions, t: str = "t") -> DataFrame:
    """Cuts by row rank with a dead zone that shrinks to half and to nothing when a side would
    keep less than ``min_frac`` of the group. One row per ``by`` group."""
    hist = df.groupBy(*by, t).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(hist, by, [F.col(t)], {"n": F.col("n")})
    size = ranked.groupBy(*by).agg(
        F.sum("n").alias("total"), F.min(t).alias("_lo"), F.max(t).alias("_hi")
    )
    a = F.greatest((F.col("total") * options.train_frac).cast("bigint"), F.lit(1))
    b_raw = (F.col("total") * (options.train_frac + options.val_frac)).cast("bigint")
    size = size.withColumn("i_a", F.least(a, F.col("total") - 2)).withColumn(
        "i_b", F.least(F.greatest(b_raw, F.col("i_a") + 1), F.col("total") - 1)
    ).withColumn("gap", adaptive_gap(F.col("_hi") - F.col("_lo"), options.gap_seconds))
    placed = ranked.join(F.broadcast(size), by) if by else ranked.crossJoin(F.broadcast(size))

    def at(rank):
        inside = (F.col("n_before") <= F.col(rank)) & (F.col(rank) < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(t)))

    cuts = placed.groupBy(*by).agg(at("i_a").alias("t_a"), at("i_b").alias("t_b"))
    timed = placed.join(F.broadcast(cuts), by) if by else placed.crossJoin(F.broadcast(cuts))

    def kept(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    def smallest(gap):
        x, ta, tb = F.col(t), F.col("t_a"), F.col("t_b")
        return F.least(
            kept(x < ta - gap), kept((x > ta + gap) & (x < tb - gap)), kept(x > tb + gap)
        )

    half = F.floor(F.col("gap") / 2)
    first = [F.first(c).alias(c) for c in ("total", "i_a", "i_b", "gap", "t_a", "t_b")]
    checked = timed.groupBy(*by).agg(
        *first, smallest(F.col("gap")).alias("_full"), smallest(half).alias("_half")
    )
    floor = F.greatest((F.col("total") * options.min_frac).cast("bigint"), F.lit(1))
    zone = (
        F.when(F.col("_full") >= floor, F.col("gap")).when((half > 0) & (F.col("_half") >= floor), half)
        .otherwise(F.lit(0))
    )
    return checked.withColumn("zone", zone).select(
        *by, F.lit("rank").alias("mode"), "total", "zone",
        F.when(F.col("total") < 3, F.lit(FAR)).otherwise(F.col("t_a") - F.col("zone")).alias("train_below"),
        (F.col("t_a") + F.col("zone") + 1).alias("val_from"),
        (F.col("t_b") - F.col("zone")).alias("val_below"),
        F.when(F.col("total") < 3, F.lit(FAR)).otherwise(F.col("t_b") + F.col("zone") + 1).alias("test_from"),
        "t_a", "t_b", "i_a", "i_b",
    )


def episode_plan(df: DataFrame, by: list[str], options: SplitOptions, t: str = "t",
                 label: str = "label") -> DataFrame:
    """Whole episodes per class; background, classes with few episodes and classes whose
    episodes are too uneven fall back to the rank cut."""
    ranks = rank_plan(df, by, options, t)
    eps = episodes(df.where(F.col(label) != options.benign), by, options.episode_gap_seconds, t)
    count = eps.groupBy(*by).agg((F.max("episode") + 1).alias("n_ep"), F.sum("n").alias("_total"))
    share = lambda f: F.greatest((F.col("n_ep") * f).cast("bigint"), F.lit(1))
    count = count.withColumns({"_tr": share(options.train_frac), "_va": share(options.val_frac)})
    placed = eps.join(F.broadcast(count), by)
    in_train = F.col("episode") < F.col("_tr")
    in_test = F.col("episode") >= F.col("_tr") + F.col("_va")

    def kept(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    bounds = placed.groupBy(*by).agg(
        F.first("n_ep").alias("n_ep"), F.first("_total").alias("_total"),
        F.min(F.when(~in_train, F.col(t))).alias("_a"), F.min(F.when(in_test, F.col(t))).alias("_b"),
        F.least(kept(in_train), kept(~in_train & ~in_test), kept(in_test)).alias("_min"),
    )
    floor = F.greatest((F.col("_total") * options.min_frac).cast("bigint"), F.lit(1))
    whole = (F.col("n_ep") >= options.min_episodes) & (F.col("_min") >= floor)
    good = bounds.where(whole).select(*by, "n_ep", "_a", "_b")
    joined = ranks.join(F.broadcast(good), by, "left")
    use = F.col("_a").isNotNull()
    pick = lambda new, old: F.when(use, F.col(new)).otherwise(F.col(old))
    return joined.select(
        *by, F.when(use, "episode").otherwise("rank").alias("mode"), "total", "n_ep",
        F.when(use, F.lit(-1)).otherwise(F.col("zone")).alias("zone"),
        pick("_a", "train_below").alias("train_below"), pick("_a", "val_from").alias("val_from"),
        pick("_b", "val_below").alias("val_below"), pick("_b", "test_from").alias("test_from"),
        "t_a", "t_b", "i_a", "i_b",
    )


def apply_plan(df: DataFrame, plan: DataFrame, by: list[str], tie: list[str], t: str = "t") -> DataFrame:
    """Adds ``split``; rows in a dead zone are dropped. The plan has one row per class."""
    columns = df.columns
    rows = df.join(F.broadcast(plan), by) if by else df.crossJoin(F.broadcast(plan))
    x = F.col(t)
    # zone 0: the rows of the two boundary seconds are cut by position
    boundary = (F.col("zone") == 0) & ((x == F.col("t_a")) | (x == F.col("t_b"))) & (F.col("total") >= 3)
    by_time = (
        F.when(x < F.col("train_below"), "train")
        .when((x >= F.col("val_from")) & (x < F.col("val_below")), "val")
        .when(x >= F.col("test_from"), "test")
    )
    timed = rows.where(~boundary).select(*columns, by_time.alias("split"))
    edge = rows.where(boundary)
    hist = df.groupBy(*by, t).agg(F.count(F.lit(1)).alias("_n"))
    small = plan.select(*by, "t_a", "t_b", "zone").where(F.col("zone") == 0)
    counted = hist.join(F.broadcast(small), by) if by else hist.crossJoin(F.broadcast(small))
    before = counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(x < F.col("t_a"), F.col("_n"))), F.lit(0)).alias("_before_a"),
        F.coalesce(F.sum(F.when(x < F.col("t_b"), F.col("_n"))), F.lit(0)).alias("_before_b"),
    )
    placed = edge.join(F.broadcast(before), by) if by else edge.crossJoin(F.broadcast(before))
    ranked = row_ranks(placed, [*by, t], [F.col(c) for c in tie], "_in_second")
    start = F.when(x == F.col("t_a"), F.col("_before_a")).otherwise(F.col("_before_b"))
    position = start + F.col("_in_second")
    by_rank = (
        F.when(position < F.col("i_a"), "train").when(position < F.col("i_b"), "val").otherwise("test")
    )
    cut = ranked.select(*columns, by_rank.alias("split"))
    return timed.where(F.col("split").isNotNull()).unionByName(cut)


def split_temporal(df, options: SplitOptions, tie, t="t"):
    return apply_plan(df, rank_plan(df, [], options, t), [], tie, t)


def split_episode(df, options: SplitOptions, tie, label="label", t="t"):
    return apply_plan(df, episode_plan(df, [label], options, t, label), [label], tie, t)


def _span(df: DataFrame, options: SplitOptions, t: str) -> DataFrame:
    """One row: time span, its cut points and the dead zone."""
    lo, hi = F.min(t), F.max(t)
    share = options.train_frac / (options.train_frac + options.val_frac)
    return df.agg(lo.alias("_lo"), hi.alias("_hi")).select(
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("_cut"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * options.train_frac).alias("_cut_a"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (options.train_frac + options.val_frac)).alias("_cut_b"),
        adaptive_gap(F.col("_hi") - F.col("_lo"), options.gap_seconds).alias("_gap"),
    )


def _train_val_by_span(df: DataFrame, options: SplitOptions, t: str) -> DataFrame:
    x = F.col(t)
    side = F.when(x < F.col("_cut") - F.col("_gap"), "train").when(x > F.col("_cut") + F.col("_gap"), "val")
    return df.crossJoin(F.broadcast(_span(df, options, t))).select(*df.columns, side.alias("split")).where(
        F.col("split").isNotNull()
    )


def split_day_holdout(df, days: list[str], options: SplitOptions, day="capture_day", t="t"):
    held = F.col(day).isin(*days)
    test = df.where(held).withColumn("split", F.lit("test"))
    return _train_val_by_span(df.where(~held), options, t).unionByName(test)


def split_host_holdout(df, options: SplitOptions, seed=0, label="label", t="t"):
    """Attack hosts are disjoint between splits; background is cut by time span."""
    attack = df.where(F.col(label) != options.benign)
    hosts = host_splits(attack.select("src_ip").distinct(), "src_ip", options, seed)
    benign = df.where(F.col(label) == options.benign)
    x = F.col(t)
    side = F.when(x < F.col("_cut_a"), "train").when(x < F.col("_cut_b"), "val").otherwise("test")
    calm = benign.crossJoin(F.broadcast(_span(benign, options, t))).select(*df.columns, side.alias("split"))
    return attack.join(hosts, "src_ip").select(*df.columns, "split").unionByName(calm)


def host_splits(hosts: DataFrame, host: str, options: SplitOptions, seed: int = 0) -> DataFrame:
    """A seeded shuffle of a host table into fractions, by rank of a hash."""
    mark = F.md5(F.concat_ws(":", F.col(host), F.lit(str(seed))))
    ranked = row_ranks(hosts, [], [mark, F.col(host)], "_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))
    n_train = (F.col("_n") * options.train_frac).cast("bigint")
    n_val = (F.col("_n") * options.val_frac).cast("bigint")
    side = (
        F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.crossJoin(F.broadcast(total)).select(host, side.alias("split"))


def background(df: DataFrame, held: DataFrame, benign: str, label="label", t="t") -> DataFrame:
    """Benign rows in the time range of the held rows (a one-row range)."""
    span = held.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    rows = df.where(F.col(label) == benign).crossJoin(F.broadcast(span))
    return rows.where(F.col(t).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def split_attack_holdout(df, held_labels: list[str], options: SplitOptions, label="label", t="t"):
    """Held families and the background of their time range are the test split. Such a
    background row may also be in train or validation: it is then returned once for each."""
    is_held = F.col(label).isin(*held_labels)
    held = df.where(is_held)
    test = held.unionByName(background(df, held, options.benign, label, t))
    return _train_val_by_span(df.where(~is_held), options, t).unionByName(
        test.withColumn("split", F.lit("test"))
    )


def split_per_file(df, options: SplitOptions, order: list[Column], file="source_file"):
    """Chronological fractions inside every source file, by exact rank. ``order`` rises, and
    its first column is the time."""
    shares = (options.train_frac, options.train_frac + options.val_frac)
    cuts = lambda n: [(n * share).cast("bigint") for share in shares]
    placed = rank_segments(df, [file], order, cuts, order[0], "_side")
    side = F.when(F.col("_side") == 0, "train").when(F.col("_side") == 1, "val").otherwise("test")
    return placed.select(*df.columns, side.alias("split"))


def split_flows(df: DataFrame, strategy: str, tie: list[str], options: SplitOptions = SplitOptions(), *,
                days: list[str] = (), attacks: list[str] = (), seed: int = 0) -> DataFrame:
    if strategy == "episode":
        return split_episode(df, options, tie)
    if strategy == "temporal":
        return split_temporal(df, options, tie)
    if strategy == "day_holdout":
        return split_day_holdout(df, list(days), options)
    if strategy == "host_holdout":
        return split_host_holdout(df, options, seed)
    if strategy == "attack_holdout":
        return split_attack_holdout(df, list(attacks), options)
    if strategy == "per_file":
        return split_per_file(df, options, [F.col("t"), *[F.col(c) for c in tie]])
    raise ValueError(f"unknown split strategy: {strategy}")


def split_report(df: DataFrame, label: str = "label") -> DataFrame:
    """(split, label, n): a class missing from a split is a row with 0."""
    counts = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("split").distinct().crossJoin(counts.select(label).distinct())
    return grid.join(counts, ["split", label], "left").fillna(0, ["n"])


def missing_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """(split, label) pairs where a split has no row of a class."""
    present = df.select("split", label).distinct()
    return present.select("split").distinct().crossJoin(present.select(label).distinct()).exceptAll(present)


def clip_outliers(df: DataFrame, columns: list[str], q: float = 0.999, by: list[str] = ("split",),
                  approximate: bool = False) -> DataFrame:
    """Clip each column to its (1-q, q) quantiles within each split."""
    by = list(by)
    if approximate:
        arrays = df.groupBy(*by).agg(*[
            F.percentile_approx(c, F.array(F.lit(1 - q), F.lit(q)), 10000).alias(f"_q_{c}") for c in columns
        ])
        low, high = (lambda c: F.get(f"_q_{c}", F.lit(0))), (lambda c: F.get(f"_q_{c}", F.lit(1)))
    else:
        points = exact_percentiles(df, by, columns, [1 - q, q])
        names = {}
        for c in columns:
            names[f"_lo_{c}"] = F.min(F.when(F.col("column") == c, F.col("value")))
            names[f"_hi_{c}"] = F.max(F.when(F.col("column") == c, F.col("value")))
        arrays = points.groupBy(*by).agg(*[v.alias(k) for k, v in names.items()])
        low, high = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}"))
    # one row per split
    rows = df.join(F.broadcast(arrays), by)
    clipped = {c: F.least(F.greatest(F.col(c), low(c)), high(c)) for c in columns}
    return rows.withColumns(clipped).select(df.columns)


def settings_digest(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def splits_path(root: str, taxonomy: str, strategy: str, settings: dict) -> str:
    """A folder name that changes with every setting the rows depend on."""
    return f"{root.rstrip('/')}/splits_{taxonomy}_{strategy}_{settings_digest(settings)}"


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_splits(spark, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
