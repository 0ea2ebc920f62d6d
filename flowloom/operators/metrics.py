"""Detector evaluation from counts: confusion, curves, thresholds, calibration."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.operators.ordered import exact_percentiles, running_totals


def class_weights(df: DataFrame, beta: float = 0.9999) -> DataFrame:
    """(y, n, weight, two_class_weight) from class counts; the table has one row per class."""
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), size))
    rows = counts.withColumn("_raw", raw)
    total = rows.agg(
        F.sum("_raw").alias("_sum"), F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_all"),
        F.sum(F.when(F.col("y") > 0, F.col("n"))).alias("_attack"),
    )
    side = F.when(F.col("y") == 0, F.col("n")).otherwise(F.col("_attack"))
    return rows.crossJoin(F.broadcast(total)).select(
        "y", "n", (F.col("_raw") / F.col("_sum") * F.col("_k")).alias("weight"),
        (F.col("_all") / (2 * side)).alias("two_class_weight"),
    )


# ------------------------------------------------------------------- confusion
def confusion(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, y, pred, n): at most K x K rows per key; every class metric comes from these."""
    return df.groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(cm: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, class, support, predicted, tp, precision, recall, f1); 0 where undefined."""
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("hit")),
    ))
    rolled = cm.select(*keys, sides.alias("s")).select(*keys, "s.*").groupBy(*keys, "class").agg(
        F.sum("true_n").alias("support"), F.sum("pred_n").alias("predicted"), F.sum("hit").alias("tp")
    )
    tp = F.col("tp")
    return rolled.withColumns({
        "precision": _ratio(tp, F.col("predicted")), "recall": _ratio(tp, F.col("support")),
        "f1": _ratio(2 * tp, F.col("predicted") + F.col("support")),
    })


def summary_metrics(cm: DataFrame, n_classes: int, keys: list[str] = ()) -> DataFrame:
    """Macro F1 over the classes present and over all, weighted F1, accuracy, binary F1."""
    per = class_metrics(cm, keys)
    present = F.col("support") > 0
    a = per.groupBy(*keys).agg(
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        (F.sum("f1") / n_classes).alias("macro_f1_all"),
        F.count_if(present).alias("classes_present"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
    )
    hit = F.sum(F.when((F.col("y") > 0) & (F.col("pred") > 0), F.col("n")).otherwise(0))
    marked = F.sum(F.when(F.col("pred") > 0, F.col("n")).otherwise(0))
    attack = F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0))
    b = cm.groupBy(*keys).agg(_ratio(2 * hit, marked + attack).alias("binary_f1"))
    return a.join(b, list(keys)) if keys else a.crossJoin(b)


# ---------------------------------------------------------------------- curves
def score_curve(df: DataFrame, score: str, positive: Column, keys: list[str] = (),
                grid: DataFrame | None = None) -> DataFrame:
    """Distinct scores, highest first, with the positives and negatives at and above each.

    Equal scores are one step. ``grid`` (keys, score) adds thresholds that no row has: they
    enter as steps without rows, so a sweep costs nothing beyond the curve itself.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(score).alias("score"), positive.cast("boolean").alias("_p"))
    steps = rows.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(
        F.count_if("_p").alias("pos"), F.count_if(~F.col("_p")).alias("neg")
    ).withColumn("on_grid", F.lit(False))
    if grid is not None:
        none = F.lit(0).cast("bigint")
        extra = grid.select(*keys, "score", none.alias("pos"), none.alias("neg"), F.lit(True).alias("on_grid"))
        steps = steps.unionByName(extra).groupBy(*keys, "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bool_or("on_grid").alias("on_grid")
        )
    curve = running_totals(steps, keys, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    return curve.withColumns({
        "tp": F.col("tp_before") + F.col("pos"), "fp": F.col("fp_before") + F.col("neg"),
    })


def curve_metrics(curve: DataFrame, keys: list[str] = (), budgets: dict[str, float] = {}) -> DataFrame:
    """Average precision, ROC area and recall within false-positive budgets, in one pass."""
    keys = list(keys)
    total = curve.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    c = curve.join(F.broadcast(total), keys) if keys else curve.crossJoin(F.broadcast(total))
    P, N = F.first("_P"), F.first("_N")
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))

    def within(budget):
        limit = F.greatest((F.col("_N") * budget).cast("bigint"), F.lit(1))
        return F.coalesce(F.max(F.when(F.col("fp") <= limit, F.col("tp"))), F.lit(0)) / F.greatest(P, F.lit(1))

    return c.groupBy(*keys).agg(
        F.when(P > 0, F.sum(F.col("pos") * precision) / P).alias("average_precision"),
        F.when((P > 0) & (N > 0), F.sum(F.col("neg") * (F.col("tp_before") + F.col("pos") / 2)) / P / N).alias("roc_auc"),
        *[within(b).alias(name) for name, b in budgets.items()],
    )


def threshold_for_precision(curve: DataFrame, target: float, keys: list[str] = ()) -> DataFrame:
    """Lowest score at which precision still reaches the target."""
    good = F.col("tp") >= target * (F.col("tp") + F.col("fp"))
    return curve.where(F.col("tp") + F.col("fp") > 0).groupBy(*keys).agg(
        F.min(F.when(good, F.col("score"))).alias("threshold")
    )


def fpr_at_tpr(df: DataFrame, score: str, positive: Column, targets: list[float]) -> DataFrame:
    """(target, threshold, fpr): the threshold is a quantile of the positives' scores."""
    marked = df.select(F.col(score).alias("score"), positive.alias("_p"))
    cuts = exact_percentiles(marked.where("_p"), [], ["score"], [1.0 - x for x in targets])
    # one threshold per target, so one conditional mean each in a single pass over the negatives
    found = sorted((c.prob, c.value) for c in cuts.select("prob", "value").collect())
    if not found:
        return cuts.select(F.lit(0.0).alias("target"), F.col("value").alias("threshold"), F.lit(0.0).alias("fpr"))
    means = marked.where(~F.col("_p")).agg(*[
        F.avg((F.col("score") >= F.lit(value)).cast("double")).alias(f"m{k}") for k, (_, value) in enumerate(found)
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(round(1.0 - prob, 6)).alias("target"), F.lit(value).alias("threshold"), F.col(f"m{k}").alias("fpr"))
        for k, (prob, value) in enumerate(found)
    ]))
    return means.select(rows.alias("r")).select("r.*").where(F.col("fpr").isNotNull())


def oscr(df: DataFrame, score: str, unknown: Column, correct: Column) -> DataFrame:
    """Open-set curve: per threshold the share of known rows accepted and right, and of
    unknown rows accepted. A row is accepted when its score is at most the threshold."""
    steps = df.select(F.col(score).alias("score"), unknown.alias("_u"), correct.alias("_c")).groupBy("score").agg(
        F.count_if(~F.col("_u") & F.col("_c")).alias("right"), F.count_if("_u").alias("unknown"),
        F.count_if(~F.col("_u")).alias("known"),
    )
    curve = running_totals(steps, [], [F.col("score")], {"right": F.col("right"), "unknown": F.col("unknown")})
    sizes = steps.agg(F.sum("known").alias("_k"), F.sum("unknown").alias("_n"))
    c = curve.crossJoin(F.broadcast(sizes))
    return c.select(
        "score", ((F.col("right_before") + F.col("right")) / F.col("_k")).alias("ccr"),
        ((F.col("unknown_before") + F.col("unknown")) / F.col("_n")).alias("fpr"),
        (F.col("right_before") / F.col("_k")).alias("ccr_before"), (F.col("unknown") / F.col("_n")).alias("d_fpr"),
    )


def oscr_area(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("d_fpr") * (F.col("ccr") + F.col("ccr_before")) / 2).alias("oscr_auc"))


def open_set_report(df: DataFrame, score: str, unknown_label: int) -> DataFrame:
    """One row for a held-out family: open-set area, FPR at TPR, accuracy on knowns, and how
    well the family separates from background alone."""
    unknown = F.col("y") == unknown_label
    right = F.col("y") == F.col("pred")
    area = oscr_area(oscr(df, score, unknown, right))
    rates = fpr_at_tpr(df, score, unknown, [0.95, 0.80]).agg(
        F.max(F.when(F.col("target") == 0.95, F.col("fpr"))).alias("fpr_at_95tpr"),
        F.max(F.when(F.col("target") == 0.80, F.col("fpr"))).alias("fpr_at_80tpr"),
    )
    accuracy = df.where(~unknown).agg(F.avg(right.cast("double")).alias("known_accuracy"))
    calm = df.where(unknown | (F.col("y") == 0))
    versus = curve_metrics(score_curve(calm, score, unknown)).select(
        F.col("roc_auc").alias("ood_auroc"), F.col("average_precision").alias("ood_ap")
    )
    benign = fpr_at_tpr(calm, score, unknown, [0.95]).select(F.col("fpr").alias("fpr_at_95tpr_vs_benign"))
    return area.crossJoin(rates).crossJoin(accuracy).crossJoin(versus).crossJoin(benign)


# ------------------------------------------------------------------ thresholds
def threshold_grid(df: DataFrame, score: str, keys: list[str] = (), points: int = 400,
                   fixed: list[float] = ()) -> DataFrame:
    """(keys, score): quantiles of the scores and the fixed values, without repeats."""
    probs = [i / (points - 1) for i in range(points)]
    named = df.withColumnRenamed(score, "score") if score != "score" else df
    cuts = exact_percentiles(named, list(keys), ["score"], probs).select(*keys, F.col("value").alias("score"))
    if fixed:
        groups = cuts.select(*keys).distinct() if keys else cuts.limit(1).select()
        extra = groups.select(*keys, F.explode(F.array(*[F.lit(x) for x in fixed])).alias("score"))
        cuts = cuts.unionByName(extra)
    return cuts.distinct()


def threshold_table(curve: DataFrame, keys: list[str] = (), totals: DataFrame | None = None) -> DataFrame:
    """Counts and rates at each grid threshold of a ``score_curve``. ``totals`` (keys, P, N)
    replaces the curve's own totals when rows outside the curve can never fire."""
    keys = list(keys)
    if totals is None:
        totals = curve.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = curve.where("on_grid")
    t = grid.join(F.broadcast(totals), keys) if keys else grid.crossJoin(F.broadcast(totals))
    tp, fp = F.col("tp"), F.col("fp")
    out = t.select(
        *keys, F.col("score").alias("threshold"), "tp", "fp", (F.col("P") - tp).alias("fn"), (F.col("N") - fp).alias("tn"),
        F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(F.col("P") > 0, tp / F.col("P")).alias("recall"),
        F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def operating_points(table: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, criterion, threshold, precision, recall, fpr): best F1, and best recall under
    false-positive and precision limits; no row when a limit cannot be met."""
    limits = {
        "max_f1": (F.lit(True), F.col("f1")),
        "fpr_le_0.01": (F.col("fpr") <= 0.01, F.col("recall")),
        "fpr_le_0.001": (F.col("fpr") <= 0.001, F.col("recall")),
        "precision_ge_0.99": (F.col("precision") >= 0.99, F.col("recall")),
        "precision_ge_0.999": (F.col("precision") >= 0.999, F.col("recall")),
    }
    options = F.explode(F.filter(
        F.array(*[F.struct(F.lit(k).alias("criterion"), test.alias("ok"), by.alias("by")) for k, (test, by) in limits.items()]),
        lambda o: o.ok,
    ))
    rows = table.withColumn("_o", options)
    best = F.max_by(
        F.struct("threshold", "precision", "recall", "fpr", "f1"), F.struct("_o.by", -F.col("threshold"))
    )
    return rows.groupBy(*keys, F.col("_o.criterion").alias("criterion")).agg(best.alias("_b")).select(*keys, "criterion", "_b.*")


def window_alerts(df: DataFrame, gated: Column, counts: list[int]) -> DataFrame:
    """Alert when at least k flows of a window pass the gate, for each k."""
    per = df.groupBy("window_id").agg(
        F.count_if(gated).alias("_hot"), (F.count_if(F.col("y") > 0) > 0).alias("_attack")
    )
    k = F.explode(F.array(*[F.lit(c) for c in counts])).alias("min_flows")
    tried = per.select("_hot", "_attack", k)
    fired, attack = F.col("_hot") >= F.col("min_flows"), F.col("_attack")
    rows = tried.groupBy("min_flows").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(attack).alias("attack_windows"), F.count_if(fired).alias("alerted"),
        F.count_if(fired & attack).alias("tp"), F.count_if(fired & ~attack).alias("fp"),
        F.count_if(~fired & attack).alias("fn"), F.count_if(~fired & ~attack).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)), "recall": F.when(tp + fn > 0, tp / (tp + fn)),
        "fpr": F.when(fp + tn > 0, fp / (fp + tn)), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def source_rows(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(score).alias("score"), F.bool_or(F.col("y") > 0).alias("attack"))


def base_rates(df: DataFrame, keys: list[str], score: str = "threat") -> DataFrame:
    """Attack share of flows and of source rows, in one row."""
    flows = df.agg(F.count(F.lit(1)).alias("n_flows"), F.avg((F.col("y") > 0).cast("double")).alias("flow_rate"))
    src = source_rows(df, score, keys).agg(
        F.count(F.lit(1)).alias("n_sources"), F.avg(F.col("attack").cast("double")).alias("source_rate")
    )
    return flows.crossJoin(src)


def confidence_quantiles(df: DataFrame, probs: list[float], floor: float) -> DataFrame:
    """Per (true, predicted) pair: confidence quantiles and the share at or above the floor."""
    keys = ["y", "pred"]
    q = exact_percentiles(df, keys, ["conf"], probs)
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(round(p * 100)):02d}") for p in probs
    ])
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("conf") >= floor).cast("double")).alias("share_at_floor")
    )
    return wide.join(counts, keys)


# --------------------------------------------------------------- probabilities
def pooled_probabilities(df: DataFrame, keys: list[str], n_classes: int, probs: str = "probs") -> DataFrame:
    """Mean probability vector per original flow over its submissions."""
    means = [F.avg(F.get(F.col(probs), F.lit(k))) for k in range(n_classes)]
    return df.groupBy(*keys).agg(F.array(*means).alias(probs), F.count(F.lit(1)).alias("submissions"))


def calibration_bins(df: DataFrame, conf: str = "conf", bins: int = 10) -> DataFrame:
    right = (F.col("y") == F.col("pred")).cast("double")
    bucket = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bucket.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_conf"), F.avg(right).alias("accuracy")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_conf") - F.col("accuracy"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def never_predicted(cm: DataFrame) -> DataFrame:
    true = cm.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("n_true"))
    pred = cm.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("n_pred"))
    both = true.join(pred, "class", "full").fillna(0)
    return both.where((F.col("n_true") > 0) & (F.col("n_pred") == 0))


# --------------------------------------------------------------------- compare
def metric_deltas(a: DataFrame, b: DataFrame, keys: list[str], metric: str = "f1", band: float = 0.05) -> DataFrame:
    """Per class: both values, the difference and a verdict by the band."""
    left = a.select(*keys, F.col(metric).alias("before"))
    right = b.select(*keys, F.col(metric).alias("after"))
    d = left.join(right, keys, "full").fillna(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    verdict = F.when(F.col("delta") >= band, "better").when(F.col("delta") <= -band, "worse").otherwise("same")
    return d.withColumn("verdict", verdict)


def splits_agree(deltas_a: DataFrame, deltas_b: DataFrame, keys: list[str], rule: float = 0.02) -> DataFrame:
    """Do two splits show a change of the same direction? Changes under the rule count as none."""
    def direction(c):
        return F.when(c > rule, 1).when(c < -rule, -1).otherwise(0)

    a = deltas_a.select(*keys, F.col("delta").alias("delta_a"))
    b = deltas_b.select(*keys, F.col("delta").alias("delta_b"))
    return a.join(b, keys).withColumn("agree", direction(F.col("delta_a")) == direction(F.col("delta_b")))


def prediction_changes(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """(y, n, changed, max_delta, recall_before, recall_after) between two scorings."""
    left = a.select(*ids, "y", F.col("probs").alias("_p"), F.col("pred").alias("_a"))
    right = b.select(*ids, F.col("probs").alias("_q"), F.col("pred").alias("_b"))
    joined = left.join(right, ids)
    delta = F.array_max(F.zip_with("_p", "_q", lambda x, y: F.abs(x - y)))
    return joined.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") != F.col("_b")).alias("changed"),
        F.max(delta).alias("max_delta"), F.avg((F.col("_a") == F.col("y")).cast("double")).alias("recall_before"),
        F.avg((F.col("_b") == F.col("y")).cast("double")).alias("recall_after"),
    )


def require_change(changes: DataFrame, tolerance: float = 1e-9) -> None:
    """A study in which nothing moved did not test anything: refuse it."""
    row = changes.agg(F.max("max_delta").alias("d"), F.sum("changed").alias("c")).first()
    if not row.c and (row.d or 0.0) <= tolerance:
        raise ValueError("the two scorings are identical: the change under study had no effect")


def normalised_ranks(df: DataFrame, scores: dict[str, str], total: int | None = None) -> DataFrame:
    """Adds ``<name>`` = rows with a lower score over (rows - 1); equal scores share a rank."""
    out = df
    size = df.agg(F.count(F.lit(1)).alias("_total"))
    for name, score in scores.items():
        steps = df.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        ranked = running_totals(steps, [], [F.col("_s")], {"_below": F.col("_n")})
        ranked = ranked.select(F.col("_s").alias(score), F.col("_below_before").alias("_below"))
        out = out.join(ranked, score).crossJoin(F.broadcast(size)).withColumn(
            name, F.col("_below") / F.greatest(F.col("_total") - 1, F.lit(1))
        ).drop("_below", "_total")
    return out


def combined_scores(df: DataFrame, threat: str, distance: str, weight: float = 0.5) -> DataFrame:
    """Adds ``cascade`` and ``blended``; ``pred`` is the closed-set class."""
    r = normalised_ranks(df, {"_rt": threat, "_rd": distance})
    attack = F.col("pred") != 0
    return r.withColumns({
        "cascade": F.when(attack, 0.5 + 0.5 * F.col("_rt")).otherwise(0.5 * F.col("_rd")),
        "blended": F.when(attack, F.col("_rt")).otherwise((1 - weight) * F.col("_rt") + weight * F.col("_rd")),
    }).drop("_rt", "_rd")


# -------------------------------------------------------------- class offsets
def fit_class_offsets(
    df: DataFrame, n_classes: int, *, rounds: int = 4, grid: int = 33, span: float = 8.0,
    max_class_drop: float = 0.05, min_gain: float = 0.02, min_support: int = 200,
) -> list[float]:
    """Per-class log-probability offsets, kept only if held-out rows improve.

    ``df`` has y, probs and part (fit / check). When one class's offset moves, a row flips to
    that class exactly when the offset passes the row's margin. So a whole grid of trials is
    one histogram over (y, best other class, grid cell of the margin), at most
    ``K * K * (grid + 1)`` rows, instead of one pass per trial. Class 0 keeps offset 0.
    """
    base = df.select("part", "y", F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("_l"))

    def counts(offsets, part):
        moved = F.zip_with("_l", F.array(*[F.lit(float(b)) for b in offsets]), lambda a, b: a + b)
        pred = F.array_position(moved, F.array_max(moved)) - 1
        rows = base.where(F.col("part") == part).groupBy("y", pred.cast("int").alias("pred")).count().collect()
        return {(r.y, r.pred): r["count"] for r in rows}

    def f1(cm):
        out = []
        for c in range(n_classes):
            tp = cm.get((c, c), 0)
            size = sum(n for (y, p), n in cm.items() if y == c) + sum(n for (y, p), n in cm.items() if p == c)
            out.append(2 * tp / size if size else 0.0)
        return out

    support = {r.y: r["count"] for r in base.where("part = 'check'").groupBy("y").count().collect()}
    zero = [0.0] * n_classes
    if any(0 < n < min_support for n in support.values()):
        return zero
    start = f1(counts(zero, "fit"))
    offsets, best, step = list(zero), sum(start) / n_classes, span
    for _ in range(rounds):
        for c in range(1, n_classes):
            width = 2 * step / (grid - 1)
            moved = F.zip_with("_l", F.array(*[F.lit(float(b)) for b in offsets]), lambda a, b: a + b)
            others = F.transform(moved, lambda x, i: F.when(i == c, float("-inf")).otherwise(x))
            top = F.array_max(others)
            rival = (F.array_position(others, top) - 1).cast("int")
            margin = top - F.get(moved, F.lit(c))
            cell = F.least(F.greatest(F.floor((margin + step) / width) + 1, F.lit(0)), F.lit(grid))
            hist = base.where("part = 'fit'").select("y", "_l").groupBy(
                "y", rival.alias("rival"), cell.cast("int").alias("cell")
            ).count().collect()
            found = None
            for j in range(grid):
                cm = {}
                for row in hist:
                    pred = c if j >= row.cell else row.rival
                    cm[(row.y, pred)] = cm.get((row.y, pred), 0) + row["count"]
                scores = f1(cm)
                mean = sum(scores) / n_classes
                if mean > best and all(a >= b - max_class_drop for a, b in zip(scores, start)):
                    best, found = mean, offsets[c] - step + j * width
            if found is not None:
                offsets[c] = found
        step /= 3.0
    before, after = f1(counts(zero, "check")), f1(counts(offsets, "check"))
    gain = (sum(after) - sum(before)) / n_classes
    worst = min(a - b for a, b in zip(after, before))
    return zero if gain < min_gain or worst < -max_class_drop else offsets
