"""Seeded, repeatable samples and row batches."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.operators.ordered import hash_segments, row_ranks
from flowloom.workspace import checked_broadcast


def row_windows(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Fixed-size batches of rows in a total order: adds ``position`` and ``batch``."""
    ranked = row_ranks(df, [], order, "position")
    return ranked.withColumn("batch", F.floor(F.col("position") / size))


def stratified_halves(df: DataFrame, label: str, tie: list[str], check_frac: float, seed: int = 0) -> DataFrame:
    """Adds ``part`` (fit / check): an exact share of each class in hash order."""
    kept = lambda n: [F.greatest(F.lit(1), F.bround(n * (1.0 - check_frac), 0).cast("bigint"))]
    halves = hash_segments(df, [label], tie, seed, kept, "_half")
    part = F.when(F.col("_half") == 0, "fit").otherwise("check")
    return halves.select(*df.columns, part.alias("part"))


def edge_mask(df: DataFrame, rate: float, keys: list[str], tie: list[str], seed: int = 0) -> DataFrame:
    """Adds ``masked``: the first ``floor(rate * n)`` edges of each window in hash order."""
    chosen = hash_segments(df, keys, tie, seed, lambda n: [F.floor(n * rate)], "_side")
    return chosen.select(*df.columns, (F.col("_side") == 0).alias("masked"))


def best_runs(windows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Per key, the contiguous run of windows with the most usable windows whose rows fit the
    budget; fewest rows on a tie, then the earliest end.

    ``windows`` has one row per (key, window): n, usable. With prefix sums of rows, the best
    run that ends at a window starts at the first usable window whose prefix is within the
    budget. That start is found by a range frame over the prefix sum, so there is no self
    join of windows. Group size is the number of windows of a key, not of rows.
    """
    order = Window.partitionBy(*keys).orderBy("window_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = windows.withColumns({
        "_rows": F.sum("n").over(upto), "_good": F.sum(F.col("usable").cast("bigint")).over(upto),
    }).withColumn("_start", F.col("_rows") - F.col("n"))
    # rows before the run >= rows up to its end - budget; every n is at least 1, so prefix
    # sums are distinct and order the windows
    reach = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    starts = sums.where("usable").select(
        *keys, (F.col("_start")).alias("_at"), F.lit(0).alias("_kind"),
        F.struct(F.col("window_id").alias("w"), F.col("_start").alias("s"),
                 (F.col("_good") - 1).alias("g")).alias("_from"),
        F.lit(None).cast("struct<w:bigint,r:bigint,g:bigint>").alias("_to"),
    )
    ends = sums.select(
        *keys, (F.col("_rows") - budget).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast("struct<w:bigint,s:bigint,g:bigint>").alias("_from"),
        F.struct(F.col("window_id").alias("w"), F.col("_rows").alias("r"), F.col("_good").alias("g")).alias("_to"),
    )
    first = F.last("_from", ignorenulls=True).over(
        reach.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = starts.unionByName(ends).withColumn("_first", first)
    runs = both.where((F.col("_kind") == 1) & F.col("_first").isNotNull()).select(
        *keys, F.col("_first.w").alias("first_window"), F.col("_to.w").alias("last_window"),
        (F.col("_to.g") - F.col("_first.g")).alias("usable_windows"),
        (F.col("_to.r") - F.col("_first.s")).alias("n_rows"),
    ).where((F.col("last_window") >= F.col("first_window")) & (F.col("usable_windows") > 0))
    best = F.max_by(
        F.struct("first_window", "last_window", "usable_windows", "n_rows"),
        F.struct("usable_windows", -F.col("n_rows"), -F.col("last_window")),
    )
    return runs.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def rows_of_runs(df: DataFrame, runs: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Source rows of the chosen windows, each source row once."""
    spans = checked_broadcast(runs.select(*keys, "first_window", "last_window"), "runs")
    chosen = df.join(spans, keys).where(
        F.col("window_id").between(F.col("first_window"), F.col("last_window"))
    )
    return chosen.drop("first_window", "last_window").dropDuplicates(identity)
