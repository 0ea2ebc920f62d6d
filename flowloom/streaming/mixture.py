"""A mixture that follows its vectors window by window, and takes in only what looks like it.

State is one row per component with its matrices. In a step, tasks score their vectors against
the components (a broadcast of known size), and add up the accepted ones; one row per task and
component is shuffled. Each component is then updated by one task: its mean and covariance move
towards the accepted vectors, are drawn back to the fitted covariance by a fixed share, and are
shrunk towards the isotropic matrix every ``resync_every`` steps.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STATE = (
    "component int, label int, mean array<double>, cov array<double>, cov0 array<double>, n_updates bigint, steps bigint"
)
NAMES = [field.split()[0] for field in STATE.split(", ")]
SUMS = "component int, n bigint, rejected bigint, s array<double>, ss array<double>"
MAX_STATE_BYTES = 64 << 20


def state_rows(spark, components: list[dict]) -> DataFrame:
    """Components of a fitted mixture as state."""
    rows = [
        (i, c["label"], list(map(float, c["mean"])), np.ravel(c["cov"]).tolist(), np.ravel(c["cov"]).tolist(), 0, 0)
        for i, c in enumerate(components)
    ]
    return spark.createDataFrame(rows, STATE)


def factor(cov: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Lower triangular factor of a covariance. One that is not positive definite is drawn a tenth
    towards its isotropic matrix; if that fails as well, the isotropic matrix is used."""
    d = len(cov)
    if not np.isfinite(cov).all():
        raise ValueError("covariance holds values that are not finite")
    spread = max(np.trace(cov) / d, floor)
    for share in (0.0, 0.1):
        try:
            return np.linalg.cholesky((1 - share) * cov + (share * spread + floor) * np.eye(d))
        except np.linalg.LinAlgError:
            continue
    return np.sqrt(spread) * np.eye(d)


def distances(x: np.ndarray, means: list[np.ndarray], factors: list[np.ndarray]) -> np.ndarray:
    """Squared distance of every vector to every component."""
    return np.stack([((np.linalg.solve(f, (x - m).T)) ** 2).sum(0) for m, f in zip(means, factors, strict=True)], axis=1)


@dataclass
class Following:
    """How a mixture follows. ``threshold``: largest squared distance that is taken in."""

    threshold: float
    half_life: float = 200.0
    anchor: float = 0.02
    resync_every: int = 500
    resync_share: float = 0.05
    floor: float = 1e-6

    @property
    def pace(self) -> float:
        return 1.0 - 0.5 ** (1.0 / max(self.half_life, 1.0))

    def moved(self, mean: np.ndarray, cov: np.ndarray, cov0: np.ndarray, n: int, s: np.ndarray, ss: np.ndarray):
        """Mean and covariance after a window with ``n`` accepted vectors of the given sums."""
        a, centre = self.pace, s / n
        new = mean + a * (centre - mean)
        # Mean of (x - old mean)(x - new mean)^T.
        cross = ss / n - np.outer(centre, new) - np.outer(mean, centre) + np.outer(mean, new)
        cov = (1 - a) * cov + a * (cross + cross.T) / 2
        return new, (1 - self.anchor) * cov + self.anchor * cov0

    def resynced(self, cov: np.ndarray) -> np.ndarray:
        spread = np.trace(cov) / len(cov)
        return (1 - self.resync_share) * cov + self.resync_share * spread * np.eye(len(cov))

    # ---------------------------------------------------------------- one step
    def _partial(self, components: list) -> callable:
        means = [np.array(c["mean"]) for c in components]
        ids = [c["component"] for c in components]
        factors = [factor(np.array(c["cov"]).reshape(len(m), -1), self.floor) for c, m in zip(components, means, strict=True)]
        d = len(means[0])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, rejected = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            s, ss = np.zeros((len(ids), d)), np.zeros((len(ids), d, d))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                gap = distances(x, means, factors)
                nearest = gap.argmin(1)
                inside = gap.min(1) <= self.threshold
                for j in np.unique(nearest):
                    own = x[(nearest == j) & inside]
                    n[j] += len(own)
                    rejected[j] += ((nearest == j) & ~inside).sum()
                    s[j] += own.sum(0)
                    ss[j] += own.T @ own
            met = np.flatnonzero(n + rejected)
            yield pa.record_batch(
                [pa.array([ids[j] for j in met], pa.int32()), pa.array(n[met]), pa.array(rejected[met]),
                 pa.array(s[met].tolist(), pa.list_(pa.float64())), pa.array(ss[met].reshape(len(met), d * d).tolist(), pa.list_(pa.float64()))],
                names=["component", "n", "rejected", "s", "ss"],
            )

        return work

    def _updated(self, state: pa.Table, sums: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        mean, d = np.array(row["mean"]), len(row["mean"])
        cov, cov0 = np.array(row["cov"]).reshape(d, d), np.array(row["cov0"]).reshape(d, d)
        n, rejected = sum(sums["n"].to_pylist()), sum(sums["rejected"].to_pylist())
        if n:
            s, ss = (np.sum(np.array(sums[c].to_pylist()), axis=0) for c in ("s", "ss"))
            mean, cov = self.moved(mean, cov, cov0, n, s, ss.reshape(d, d))
        steps = row["steps"] + 1
        if self.resync_every and steps % self.resync_every == 0:
            cov = self.resynced(cov)
        row |= {"mean": mean.tolist(), "cov": cov.ravel().tolist(), "n_updates": row["n_updates"] + n, "steps": steps}
        return pa.Table.from_pylist([row | {"accepted": n, "rejected": rejected}], _arrow_schema(STATE + REPORT))

    def step(self, state: DataFrame, rows: DataFrame, window: int, vector: str = "z") -> DataFrame:
        """The state after one window, with how many vectors each component took in and refused.
        Null vectors are in no window. A component that no vector is nearest to only counts the
        step."""
        size = state.agg(F.sum(F.size("cov") * 8 + F.size("mean") * 8)).first()[0] or 0
        if size > MAX_STATE_BYTES:
            raise ValueError(f"the components hold {size} bytes; scoring broadcasts at most {MAX_STATE_BYTES}")
        components = state.orderBy("component").collect()
        sums = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(
            self._partial(components), SUMS
        )
        updated = lambda of_state, of_sums: self._updated(of_state, of_sums)
        return state.groupBy("component").cogroup(sums.groupBy("component")).applyInArrow(updated, STATE + REPORT)


REPORT = ", accepted bigint, rejected bigint"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}


def _arrow_schema(fields: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])
