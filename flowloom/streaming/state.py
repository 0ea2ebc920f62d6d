"""Keyed state over closed windows: host history, host memory, drifting moments, adaptive
thresholds, mixture updates.

Inputs are per-window aggregates, so one key has one row per window however many flows it
had. The per-key functions are small; Spark partitions, orders and stores the state.
"""

from itertools import accumulate
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(frames, column="window_end") -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(column, kind="mergesort")


def _windows(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, flows) of a key's windows in order."""
    frames = list(frames)
    ends, flows = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("window_end", "flows_now"))
    order = np.argsort(ends, kind="stable")
    return ends[order], flows[order].astype(np.int64)


def _silences(ends: np.ndarray, last: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The places among a key's ordered windows before which it was silent for longer than ``ttl``,
    and when what was known before each expired. Nothing expires before the first window of a key
    that is not known."""
    before = np.append(last or ends[0], ends[:-1])
    cuts = np.flatnonzero(ends - before > ttl)
    return cuts, before[cuts] + ttl


def _remembered(values: np.ndarray, start: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running totals of ``values`` from ``start`` that begin anew at every cut, and those let go there."""
    totals = start + np.cumsum(values)
    anew = np.append(0, (totals - values)[cuts])
    kept = totals - anew[np.searchsorted(cuts, np.arange(len(values)), side="right")]
    return kept, np.append(start, kept)[cuts]


def _with_expired(key: str, cuts: np.ndarray, names: list[str], *columns: tuple) -> pd.DataFrame:
    """All rows of a key in one frame, with those of what expired at the ``cuts``. ``columns`` are
    (values of its windows, values of the expired rows), in the order of ``names`` after key,
    window_end and event."""
    (ends, expired), rest = columns[0], columns[1:]
    merged = [np.insert(values, cuts, gone) for values, gone in ((ends, expired), (np.full(len(ends), "seen", object), "expired"), *rest)]
    return pd.DataFrame(dict(zip(names, [key, *merged], strict=True)))


def _expire_later(state: GroupState, last: int, ttl: int) -> None:
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + ttl) * 1000))


# ----------------------------------------------------------------- host history
HISTORY_OUT = "ip string, window_end bigint, event string, windows_before bigint, mean_flows_before double, burst double"
HISTORY_NAMES = [f.split()[0] for f in HISTORY_OUT.split(", ")]


def _history(ttl: int):
    def gone(ip: str, at: int, seen: int, total: int) -> pd.DataFrame:
        return pd.DataFrame([(ip, at, "expired", seen, total / max(seen, 1), np.nan)], columns=HISTORY_NAMES)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        seen, total, last = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield gone(key[0], last + ttl, seen, total)
            return
        ends, now = _windows(frames)
        cuts, expired = _silences(ends, last, ttl)
        count, gone_count = _remembered(np.ones_like(now), seen, cuts)
        flows, gone_flows = _remembered(now, total, cuts)
        mean = (flows - now) / np.maximum(count - 1, 1)
        yield _with_expired(
            key[0], cuts, HISTORY_NAMES, (ends, expired), (count - 1, gone_count),
            (mean, gone_flows / np.maximum(gone_count, 1)), (now / np.maximum(mean, 1.0), np.nan),
        )
        seen, total, last = int(count[-1]), int(flows[-1]), int(ends[-1])
        state.update((seen, total, last))
        _expire_later(state, last, ttl)

    return step


def host_history_stream(nodes: DataFrame, ttl: int = 86400, delay: str = "1 minute") -> DataFrame:
    """``nodes``: ip, window_end (seconds), flows_now, at (event time). A host that is silent for
    longer than ``ttl`` is let go with a row of event ``expired``, at the time it expired, and starts
    anew if it returns; whether its timer or its return comes first changes no row."""
    return nodes.withWatermark("at", delay).groupBy("ip").applyInPandasWithState(
        _history(ttl), HISTORY_OUT, "seen bigint, total bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


# ------------------------------------------------------------------ host memory
MEMORY_OUT = "ip string, window_end bigint, event string, tier string, cold boolean, slot string, flow_count bigint, flows_now bigint"
MEMORY_NAMES = [f.split()[0] for f in MEMORY_OUT.split(", ")]


def subnet_of(ip: str) -> str:
    return ip.rsplit(".", 1)[0] + ".0/24"


def _memory(ttl: int, promote_at: int):
    def tier(flows: np.ndarray) -> np.ndarray:
        return np.where(flows >= promote_at, "heavy", "tail").astype(object)

    def gone(ip: str, at: int, flows: int) -> pd.DataFrame:
        return pd.DataFrame([(ip, at, "expired", tier(flows).item(), True, subnet_of(ip), flows, 0)], columns=MEMORY_NAMES)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        flows, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield gone(key[0], last + ttl, flows)
            return
        ends, now = _windows(frames)
        cuts, expired = _silences(ends, last, ttl)
        count, gone_count = _remembered(now, flows, cuts)
        cold = count - now < promote_at  # promotion takes effect from the next window
        subnet = subnet_of(key[0])
        slot = np.where(cold, subnet, key[0]).astype(object)
        yield _with_expired(
            key[0], cuts, MEMORY_NAMES, (ends, expired), (tier(count), tier(gone_count)), (cold, True), (slot, subnet),
            (count, gone_count), (now, 0),
        )
        flows, last = int(count[-1]), int(ends[-1])
        state.update((flows, last))
        _expire_later(state, last, ttl)

    return step


def host_memory_stream(nodes: DataFrame, ttl: int = 1800, promote_at: int = 2, delay: str = "1 minute") -> DataFrame:
    """First tier: which memory a host reads in each window, its own once it has been promoted,
    that of its /24 while it is cold. Hosts expire as in :func:`host_history_stream`; one that
    returns is cold again."""
    return nodes.withWatermark("at", delay).groupBy("ip").applyInPandasWithState(
        _memory(ttl, promote_at), MEMORY_OUT, "flows bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


SUBNET_OUT = "subnet string, window_end bigint, event string, cold_hosts bigint, cold_flows bigint, windows_before bigint, flows_before bigint"
SUBNET_NAMES = [f.split()[0] for f in SUBNET_OUT.split(", ")]


def _subnet(ttl: int):
    def gone(subnet: str, at: int, windows: int, flows: int) -> pd.DataFrame:
        return pd.DataFrame([(subnet, at, "expired", 0, 0, windows, flows)], columns=SUBNET_NAMES)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        windows, flows, last = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield gone(key[0], last + ttl, windows, flows)
            return
        # At most 256 hosts of a /24 have a row in a window.
        hosts = pd.concat([f.groupby("window_end")["flows_now"].agg(["size", "sum"]) for f in frames])
        hosts = hosts.groupby(level=0).sum().reset_index()
        ends, now = hosts.window_end.to_numpy(np.int64), hosts["sum"].to_numpy(np.int64)
        cuts, expired = _silences(ends, last, ttl)
        count, gone_count = _remembered(np.ones_like(now), windows, cuts)
        total, gone_flows = _remembered(now, flows, cuts)
        yield _with_expired(
            key[0], cuts, SUBNET_NAMES, (ends, expired), (hosts["size"].to_numpy(np.int64), 0), (now, 0),
            (count - 1, gone_count), (total - now, gone_flows),
        )
        windows, flows, last = int(count[-1]), int(total[-1]), int(ends[-1])
        state.update((windows, flows, last))
        _expire_later(state, last, ttl)

    return step


def subnet_memory_stream(memory: DataFrame, ttl: int = 1800, delay: str = "1 minute") -> DataFrame:
    """Second tier, over the rows that :func:`host_memory_stream` wrote: what each /24 remembers
    of the hosts that fell back to it, before each window, and when it expires. A cold host reads
    the row of its ``slot`` and window."""
    cold = memory.where("event = 'seen' AND cold").withColumn("at", F.timestamp_seconds("window_end"))
    return cold.withWatermark("at", delay).withColumnRenamed("slot", "subnet").groupBy("subnet").applyInPandasWithState(
        _subnet(ttl), SUBNET_OUT, "windows bigint, flows bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def subnet_activity(memory: DataFrame) -> DataFrame:
    """Per window and /24: hosts that fell back to it, from a finished table."""
    cold = memory.where("event = 'seen' AND cold")
    return cold.groupBy("window_end", F.col("slot").alias("subnet")).agg(F.count(F.lit(1)).alias("cold_hosts"))


# ------------------------------------------------------------------- EMA scaler
SCALER_OUT = "segment string, feature string, window_end bigint, mean double, var double, z double, drifted boolean"
SCALER_STATE = "mean double, var double, updates bigint, last bigint"


def feature_windows(rows: DataFrame, features: list[str], segment: str, window_end: str = "window_end") -> DataFrame:
    """(segment, feature, window_end, batch_mean, batch_var): all a scaler reads of a window."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = rows.select(F.col(segment).alias("segment"), F.col(window_end).alias("window_end"), cells.alias("c"))
    return long.where(~F.isnan("c.v")).groupBy("segment", F.col("c.feature").alias("feature"), "window_end").agg(
        F.avg("c.v").alias("batch_mean"), F.var_pop("c.v").alias("batch_var")
    )


class Moments(NamedTuple):
    """Mean and variance of what a scaler remembers, for one feature."""

    mean: float
    var: float

    def mixed(self, share: float, mean: float, var: float, floor: float) -> "Moments":
        """Those of a mixture that takes ``share`` from a window and the rest from memory: the
        variance is what both have inside and what lies between their means."""
        keep, apart = 1.0 - share, mean - self.mean
        return Moments(self.mean + share * apart, max(keep * self.var + share * var + share * keep * apart**2, floor))


def window_shares(ends: np.ndarray, last: int, updates: int, half_life: float, warmup: int) -> np.ndarray:
    """How much of the memory each window replaces: half of it per half-life of time passed, less
    while the scaler warms up. The first window ever counts as one half-life."""
    passed = np.diff(ends, prepend=last if last >= 0 else ends[0] - half_life).astype(float)
    full = 1.0 - np.exp2(-np.maximum(passed, 0.0) / half_life) if half_life > 0 else np.ones(len(ends))
    return full * np.minimum((updates + 1.0 + np.arange(len(ends))) / max(warmup, 1), 1.0)


def scaled_windows(rows: pd.DataFrame, ref_mean: float, ref_std: float, state=None, half_life=900.0, warmup=50,
                   sigma=3.0, eps=1e-6):
    """One feature's windows in order: (output frame, state). A mean that leaves the band of
    ``sigma`` reference deviations is drawn back to its edge before the next window."""
    mean, var, updates, last = state or (ref_mean, max(ref_std**2, eps), 0, -1)
    ends = rows.window_end.to_numpy(np.int64)
    shares = window_shares(ends, last, updates, half_life, warmup)
    low, high, unit = ref_mean - sigma * ref_std, ref_mean + sigma * ref_std, max(ref_std, eps)

    def drawn_back(m: Moments) -> Moments:
        inside = abs(m.mean - ref_mean) <= sigma * unit
        return m if inside else m._replace(mean=min(max(m.mean, low), high))

    steps = zip(shares.tolist(), rows.batch_mean.tolist(), rows.batch_var.tolist())
    seen = list(accumulate(steps, lambda m, step: drawn_back(m).mixed(*step, eps), initial=Moments(mean, var)))[1:]
    reached = np.array([m.mean for m in seen])
    z = np.abs(reached - ref_mean) / unit
    out = pd.DataFrame({
        "window_end": ends, "mean": np.where(z > sigma, np.clip(reached, low, high), reached),
        "var": [m.var for m in seen], "z": z, "drifted": z > sigma,
    })
    return out, (float(out["mean"].iloc[-1]), seen[-1].var, updates + len(seen), int(ends[-1]))


def scaler_stream(windows: DataFrame, reference: DataFrame, delay: str = "1 minute", **options) -> DataFrame:
    """State per (segment, feature). The clamp only ever moves features outside their own
    band, so features are independent. ``reference`` (feature, ref_mean, ref_std) is joined."""
    names = ["segment", "feature", "window_end", "mean", "var", "z", "drifted"]

    def step(key, frames, state: GroupState):
        rows = _ordered(frames)
        first = rows.iloc[0]
        out, after = scaled_windows(rows, first.ref_mean, first.ref_std, state.get if state.exists else None, **options)
        state.update(after)
        yield out.assign(segment=key[0], feature=key[1])[names]

    joined = windows.join(F.broadcast(reference), "feature")
    return joined.groupBy("segment", "feature").applyInPandasWithState(
        step, SCALER_OUT, SCALER_STATE, "append", GroupStateTimeout.NoTimeout
    )


def scaler_batch(windows: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """The same steps over a finished table: one group holds one feature's windows."""
    names = ["segment", "feature", "window_end", "mean", "var", "z", "drifted"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("window_end", kind="mergesort")
        out, _ = scaled_windows(rows, rows.ref_mean.iloc[0], rows.ref_std.iloc[0], None, **options)
        return out.assign(segment=key[0], feature=key[1])[names]

    return windows.join(F.broadcast(reference), "feature").groupBy("segment", "feature").applyInPandas(run, SCALER_OUT)


def drift_report(scaler: DataFrame) -> DataFrame:
    """Per segment and window: the feature farthest from its reference."""
    worst = F.max_by(F.struct("feature", "z", "drifted"), F.struct("z", "feature"))
    return scaler.groupBy("segment", "window_end").agg(worst.alias("w")).select(
        "segment", "window_end", F.col("w.feature").alias("feature"), F.col("w.z").alias("max_z"), F.col("w.drifted").alias("drifted")
    )


def standardise(rows: DataFrame, feature: str, mean, var, eps: float = 1e-6):
    """z-score expression with the scaler's moments; anything not finite becomes 0."""
    from flowloom.functions.features import finite

    return finite((F.col(feature) - mean) / F.sqrt(var + eps))


# ----------------------------------------------------------- adaptive threshold
THRESHOLD_STATE = "segment string, alpha double, scores array<double>"


def buffer_threshold(alpha, scores, low: float = 1e-4, high: float = 0.5):
    """Linear quantile of the buffered scores at 1 - alpha; infinite when there are none."""
    s = F.array_sort(scores)
    at = (1.0 - F.least(F.greatest(alpha, F.lit(low)), F.lit(high))) * (F.size(s) - 1)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    value = F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (at - lo)
    return F.when(F.size(s) > 0, value).otherwise(F.lit(float("inf")))


def _newest_scores(rows: DataFrame, order: list[str], buffer: int) -> DataFrame:
    """(segment, fresh): the last ``buffer`` scores in arrival order. Each of 64 slices of a
    segment is cut to the limit first, so a hot segment is never one group of rows."""
    slices = rows.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64)))
    for keys in (["segment", "_s"], ["segment"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
        slices = slices.withColumn("_rn", rank).where(F.col("_rn") <= buffer)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("o"), "score")))
    return slices.groupBy("segment").agg(packed.alias("p")).select(
        "segment", F.transform("p", lambda x: x["score"]).alias("fresh")
    )


def threshold_step(state: DataFrame, rows: DataFrame, order: list[str], target: float = 0.01, gamma: float = 0.01,
                   low: float = 1e-4, high: float = 0.5, buffer: int = 2000) -> DataFrame:
    """One window, with the newest ``buffer`` reference scores carried over: (segment, threshold, realised_fpr, n_reference, alpha, scores).

    ``rows`` (segment, score, order columns) are the window's scores of the reference
    population. alpha, scores are the next state."""
    cut = state.select("segment", "alpha", "scores", buffer_threshold(F.col("alpha"), F.col("scores"), low, high).alias("threshold"))
    over = rows.join(cut.select("segment", "threshold"), "segment").groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_reference"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("realised_fpr")
    )
    j = cut.join(over, "segment", "left").join(_newest_scores(rows, order, buffer), "segment", "left").fillna(0, ["n_reference"]).fillna(0.0, ["realised_fpr"])
    err = F.when(F.col("realised_fpr") > target, 1.0).otherwise(0.0)
    alpha = F.least(F.greatest(F.col("alpha") + gamma * (target - err), F.lit(low)), F.lit(high))
    merged = F.concat(F.col("scores"), F.coalesce("fresh", F.array().cast("array<double>")))
    kept = F.slice(merged, F.greatest(F.size(merged) - buffer + 1, F.lit(1)), F.lit(buffer))
    return j.select("segment", "threshold", "realised_fpr", "n_reference", alpha.alias("alpha"), kept.alias("scores"))


# --------------------------------------------------------------- mixture update
def gated_update(components: list[dict], sums: list, ema_half_life: float = 50.0, anchor: float = 0.02, eps: float = 1e-6) -> list[dict]:
    """New means and covariances from one window's accepted sums per component.

    A component is {label, mean, cov, cov0}; ``sums`` rows hold component, n, s (sum of
    vectors) and ss (sum of outer products). Only these few small matrices are on the driver.
    """
    a = 1.0 - 0.5 ** (1.0 / max(ema_half_life, 1.0))
    by_id = {r["component"]: r for r in sums}
    out = []
    for i, c in enumerate(components):
        mean, cov = np.asarray(c["mean"]), np.asarray(c["cov"])
        row = by_id.get(i)
        if row and row["n"]:
            n, d = row["n"], len(mean)
            s, ss = np.asarray(row["s"]), np.asarray(row["ss"]).reshape(d, d)
            shift = a * (s / n - mean)
            new = mean + shift
            # sum of (z - old)(z - new)^T from the raw sums
            cross = ss - np.outer(s, new) - np.outer(mean, s) + n * np.outer(mean, new)
            cov = (1 - a) * cov + a * cross / n
            cov = (1 - anchor) * cov + anchor * np.asarray(c["cov0"])
            cov = (cov + cov.T) / 2 + eps * np.eye(d)
            mean = new
        out.append({**c, "mean": mean.tolist(), "cov": cov.tolist()})
    return out
