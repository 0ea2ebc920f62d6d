"""Exact ranks, prefix sums and percentiles that never put a whole table, or a whole
hot key, into one task.

Rows are range-partitioned by (keys, order), so a hot key is cut into as many parts as its
size needs. Each part is numbered locally. What lies before a part within the same key is
added from a table of at most two rows per part. The locally numbered rows are written to a
working table first: part bounds come from a sample, and must not change between the passes.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.workspace import checked_broadcast, materialize


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Add ``<name>_before``: the sum over the rows of the same key that come earlier.

    ``order`` must be a total order within a key.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + list(order)
    placed = (
        df.withColumns({f"_v_{name}": value for name, value in totals.items()})
        .repartitionByRange(n, *by)
        .withColumn("_part", F.spark_partition_id())
    )
    earlier = (
        Window.partitionBy("_part", *keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    stored = materialize(
        placed.withColumns({
            f"{name}_before": F.coalesce(F.sum(f"_v_{name}").over(earlier), F.col(f"_v_{name}") * 0)
            for name in totals
        }),
        "ordered",
    )
    own = [F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals]
    if keys:
        key = F.struct(*keys)
        ends = stored.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        edge = stored.join(F.broadcast(ends), "_part").where(
            (key == F.col("_lo")) | (key == F.col("_hi"))
        )
    else:
        edge = stored
    per_part = edge.groupBy("_part", *keys).agg(*own)  # at most two rows per part
    before = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_part.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.col(f"_s_{name}") * 0).alias(f"_c_{name}")
          for name in totals],
    )
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    joined = stored.join(F.broadcast(carry), same, "left")
    full = joined.withColumns({
        f"{name}_before": F.coalesce(F.col(f"{name}_before") + F.col(f"_c_{name}"),
                                     F.col(f"{name}_before"))
        for name in totals
    })
    return full.drop("_part", "_p", *[f"_k_{k}" for k in keys], *[f"_v_{x}" for x in totals], *[f"_c_{x}" for x in totals])


def row_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Zero-based position of every row within its key; of all rows without keys."""
    if not keys:
        return _positions(df, order, name)
    ranked = running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
    return ranked.withColumnRenamed(f"{name}_before", name)


ROW_BITS = 33  # Spark's increasing ids have the number of the row in its partition in these


def _positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position of every row in one order over the whole table, with one exchange: rows are sorted
    in range partitions and numbered as they are written; how many rows lie in the partitions
    before comes from a table of one row for each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    stored = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_id", ROW_BITS), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = stored.join(F.broadcast(offsets), part == F.col("_part"))
    return numbered.withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def rank_segments(
    df: DataFrame, keys: list[str], order: list[Column], cuts: Callable[[Column], list[Column]], coarse: Column,
    name: str = "segment", sized: dict[str, Callable[[Column], Column]] = {},
) -> DataFrame:
    """Add ``name``: how many of the cuts of the row's key are at most the row's zero-based rank.

    Ranks are not made: rows per key and coarse value are counted, which says into which coarse
    value a cut falls, and only rows of such a value are ranked. All others stay where they are.
    ``cuts`` makes the ranks from the number of rows of a key, and ``sized`` further columns that
    ``coarse`` may use. ``coarse`` never falls along ``order``; nulls come first. Rows with a null
    key are left out. ``df`` is read several times."""
    size = F.col("_size")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sizes = checked_broadcast(counts.withColumns({c: make(size) for c, make in sized.items()}) if sized else counts, "sizes")
    at = F.col("_at")
    counts = df.join(sizes, keys).groupBy(*keys, coarse.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, keys, [at], {"_n": F.col("_n")}).join(sizes, keys)
    first, bounds = F.col("_n_before"), []
    for i, cut in enumerate(cuts(size)):
        holds = (first <= cut) & (cut < first + F.col("_n"))
        bounds += [F.max(F.when(holds, at)).alias(f"_at{i}"), F.max(F.when(holds, cut - first)).alias(f"_in{i}")]
    found = placed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in sized], *bounds)
    # of each cut: is the coarse value before its own, is it its own, and how many rows of that come before it
    sides = []
    for i in range(len(bounds) // 2):
        bound, inside = F.col(f"_at{i}"), F.col(f"_in{i}")
        before = inside.isNull() | F.coalesce(at < bound, at.isNull() & bound.isNotNull())  # null: no row is behind the cut
        sides.append((before, at.eqNullSafe(bound) & (F.coalesce(inside, F.lit(0)) > 0), inside))
    cut_through = F.lit(False)
    for _, same, _ in sides:
        cut_through = cut_through | same
    passed = lambda tests: sum((F.when(x, 0).otherwise(1) for x in tests), F.lit(0)).alias(name)
    rows = df.join(checked_broadcast(found, "rank-bounds"), keys).withColumn("_at", coarse)
    whole = rows.where(~cut_through).select(*df.columns, passed(before for before, _, _ in sides))
    ranked = row_ranks(rows.where(cut_through), [*keys, "_at"], order, "_place")
    return whole.unionByName(ranked.select(*df.columns, passed(
        before | (same & (F.col("_place") < inside)) for before, same, inside in sides
    )))


def hash_segments(
    df: DataFrame, keys: list[str], tie: list[str], seed: int, cuts: Callable[[Column], list[Column]], name: str = "segment",
) -> DataFrame:
    """``rank_segments`` in a seeded hash order: leading bits of the hash, about as many values of
    them as the square root of a key's rows."""
    mark = F.xxhash64(*tie, F.lit(seed))
    shift = lambda n: (64 - F.greatest(F.ceil(F.log2(n) / 2), F.lit(1))).cast("int")
    leading = F.call_function("shiftright", mark, F.col("_shift"))
    return rank_segments(df, keys, [mark, *[F.col(c) for c in tie]], cuts, leading, name, {"_shift": shift})


SKETCH = 20_000  # a sketched quantile is off by at most one in so many ranks


def exact_percentiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float]
) -> DataFrame:
    """(keys, column, prob, value), linearly interpolated, by selection.

    A sketch brackets every quantile; what lies below a bracket is only counted, and only the
    distinct values inside it are ranked. Should a bracket miss its ranks, or a column hold NaN
    (the largest value), the whole histogram is ranked instead. Nulls are left out."""
    cells = {c: f"_v{i}" for i, c in enumerate(columns)}
    narrow = materialize(
        df.select(*keys, *[F.col(c).cast("double").alias(v) for c, v in cells.items()]), "percentile-columns"
    )
    named = {v: c for c, v in cells.items()}
    found = _selected_percentiles(narrow, keys, list(named), probs)
    if found is None:
        found = _histogram_percentiles(narrow, keys, list(named), probs)
    original = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return found.withColumn("column", original[F.col("column")])


def _selected_percentiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame | None:
    """Percentiles from brackets; none if a bracket does not hold its ranks."""
    slack = 2.0 / SKETCH
    cuts = F.array(*[F.lit(float(min(max(p + d, 0.0), 1.0))) for p in probs for d in (-slack, slack)])
    sketched = df.groupBy(*keys).agg(
        *[F.count(c).alias(f"n{c}") for c in columns], *[F.percentile_approx(c, cuts, SKETCH).alias(f"s{c}") for c in columns],
        *[F.min(c).alias(f"min{c}") for c in columns], *[F.max(c).alias(f"max{c}") for c in columns],
        F.coalesce(F.sum(sum((F.coalesce(F.isnan(c), F.lit(False)).cast("int") for c in columns), F.lit(0))), F.lit(0)).alias("_nan"),
    )
    # The least and the largest value are their own brackets.
    pairs = [(c, k, p) for c in columns for k, p in enumerate(probs)]
    ends = {
        (c, k, side): F.col(f"min{c}") if p <= 0 else F.col(f"max{c}") if p >= 1 else F.get(f"s{c}", F.lit(2 * k + side))
        for c, k, p in pairs for side in (0, 1)
    }
    brackets = checked_broadcast(
        sketched.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], "_nan", *[f"n{c}" for c in columns],
            *[end.alias(f"{'lo' if side == 0 else 'hi'}{c}_{k}") for (c, k, side), end in ends.items()],
        ),
        "brackets",
    )
    if brackets.where("_nan > 0").limit(1).count():
        return None
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    met = df.join(brackets, same) if keys else df.crossJoin(F.broadcast(brackets))  # one row without keys
    low, high = (lambda c, k: F.col(f"lo{c}_{k}")), (lambda c, k: F.col(f"hi{c}_{k}"))
    outside = met.groupBy(*keys).agg(*[
        F.struct(
            F.count_if(F.col(c) < low(c, k)).alias("below"), F.max(F.when(F.col(c) < low(c, k), F.col(c))).alias("before"),
            F.min(F.when(F.col(c) > high(c, k), F.col(c))).alias("after"), F.max(f"n{c}").alias("n"),
        ).alias(f"o{c}_{k}") for c, k, _ in pairs
    ])
    told = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("k"), F.lit(float(p)).alias("prob"), F.col(f"o{c}_{k}").alias("o"))
        for c, k, p in pairs
    ]))
    outside = outside.select(*keys, told.alias("_t")).select(*keys, "_t.column", "_t.k", "_t.prob", "_t.o.*").where("n > 0")
    inside = F.filter(
        F.array(*[
            F.when(F.col(c).between(low(c, k), high(c, k)), F.struct(F.lit(c).alias("column"), F.lit(k).alias("k"), F.col(c).alias("value")))
            for c, k, _ in pairs
        ]),
        lambda x: x.isNotNull(),
    )
    counts = met.select(*keys, F.explode(inside).alias("_c")).groupBy(*keys, "_c.column", "_c.k", "_c.value").count()
    ranked = running_totals(counts, [*keys, "column", "k"], [F.col("value")], {"n": F.col("count")})
    held = ranked.select(
        *[F.col(x).alias(f"_k_{x}") for x in keys], F.col("column").alias("_column"), F.col("k").alias("_k"), "value",
        F.col("n_before").alias("_first"), (F.col("n_before") + F.col("count")).alias("_end"),
    )
    on = [*same, F.col("column") == F.col("_column"), F.col("k") == F.col("_k")]
    at = F.col("prob") * (F.col("n") - 1)
    joined = outside.join(held, on, "left").withColumns({"_floor": F.floor(at) - F.col("below"), "_ceil": F.ceil(at) - F.col("below")})
    holds = lambda i: (F.col(i) >= F.col("_first")) & (F.col(i) < F.col("_end"))
    total = F.max("_end")
    value = lambda i: (
        F.when(F.max(i) == -1, F.max("before")).when(F.max(i) == total, F.max("after")).otherwise(F.max(F.when(holds(i), F.col("value"))))
    )
    found = joined.groupBy(*keys, "column", "prob").agg(
        value("_floor").alias("_low"), value("_ceil").alias("_high"), F.max(at - F.floor(at)).alias("_share")
    )
    found = materialize(found, "percentiles")
    if found.where("_low IS NULL OR _high IS NULL").limit(1).count():
        return None
    return found.select(*keys, "column", "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("value"))


def _histogram_percentiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float]
) -> DataFrame:
    """Percentiles from the ranked histogram of all values."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]))
    long = df.select(*keys, cells.alias("_cell")).select(*keys, "_cell.column", "_cell.value")
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "column", "value").count()
    ranked = running_totals(counts, [*keys, "column"], [F.col("value")], {"n": F.col("count")})
    sizes = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("column").alias("_column")).agg(
        (F.sum("count") - 1).alias("_last")
    )
    same = [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("column") == F.col("_column")]
    position = lambda p: p * F.col("_last")
    first, end = F.col("n_before"), F.col("n_before") + F.col("count")

    def holds(index):
        return (index >= first) & (index < end)

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: holds(F.floor(position(p))) | holds(F.ceil(position(p))),
    )
    hits = ranked.join(sizes, same).withColumn("prob", F.explode(wanted))
    at = position(F.col("prob"))
    low = F.max(F.when(holds(F.floor(at)), F.col("value")))
    high = F.max(F.when(holds(F.ceil(at)), F.col("value")))
    share = F.max(at - F.floor(at))
    return hits.groupBy(*keys, "column", "prob").agg((low + (high - low) * share).alias("value"))


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. The limit on ``row_number`` is applied before the shuffle as
    well as after it, so a hot key sends at most ``k`` rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")
