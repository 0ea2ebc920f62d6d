"""States that step once per window, against folds in plain numpy."""

import numpy as np
import pytest

from flowloom.streaming.mixture import Following, distances, factor, state_rows
from flowloom.streaming.state import threshold_step
from flowloom.streaming.stepped import SteppedState
from pyspark.sql import functions as F


def vectors(seed, n, d):
    rnd = np.random.default_rng(seed)
    centre = rnd.integers(0, 3, n)
    return (rnd.standard_normal((n, d)) + centre[:, None] * 4).tolist()


def fold(components, windows, follow):
    """One window after the other: gate, nearest component, moving moments, anchor."""
    means = [np.array(c["mean"]) for c in components]
    covs = [np.array(c["cov"]) for c in components]
    first, out = [c.copy() for c in covs], []
    for k, x in enumerate(windows):
        gap = distances(np.array(x), means, [factor(c) for c in covs])
        a = 1 - 0.5 ** (1 / follow.half_life)
        counts = []
        for j in range(len(means)):
            own = np.array(x)[(gap.argmin(1) == j) & (gap.min(1) <= follow.threshold)]
            counts.append(len(own))
            if len(own):
                before = own - means[j]
                means[j] = means[j] + a * before.mean(0)
                covs[j] = (1 - a) * covs[j] + a * (before.T @ (own - means[j])) / len(own)
                covs[j] = (1 - follow.anchor) * covs[j] + follow.anchor * first[j]
            if (k + 1) % follow.resync_every == 0:
                mu = np.trace(covs[j]) / len(covs[j])
                covs[j] = 0.95 * covs[j] + 0.05 * mu * np.eye(len(covs[j]))
        out.append((counts, [m.copy() for m in means], [(c + c.T) / 2 for c in covs]))
    return out


@pytest.mark.parametrize("d", [3, 20])
def test_mixture_follows_as_a_fold_over_windows(spark, tmp_path, d):
    components = [{"label": j, "mean": np.full(d, 4.0 * j), "cov": np.eye(d) * (1 + j)} for j in range(3)]
    windows = [vectors(k, 200, d) for k in range(3)]
    follow = Following(threshold=1.2 * d, half_life=3, resync_every=2)
    source = str(tmp_path / "in")
    for k, x in enumerate(windows):
        spark.createDataFrame([(k, v) for v in x] + [(k, None)], "window_id bigint, z array<double>").coalesce(1).write.mode("append").parquet(source)
    steps = SteppedState(spark, str(tmp_path / "out"), state_rows(spark, components), follow.step)
    stream = spark.readStream.schema("window_id bigint, z array<double>").option("maxFilesPerTrigger", 2).parquet(source)
    steps.run(stream)
    want = fold(components, windows, follow)
    found = {(r["window"], r["component"]): r for r in steps.reports().collect()}
    assert len(found) == 9
    for k, (counts, means, covs) in enumerate(want):
        for j in range(3):
            row = found[k, j]
            assert (row["accepted"], row["steps"]) == (counts[j], k + 1)
            np.testing.assert_allclose(row["mean"], means[j], atol=1e-9)
            np.testing.assert_allclose(np.array(row["cov"]).reshape(d, d), covs[j], atol=1e-9)
    assert sum(r["accepted"] + r["rejected"] for r in found.values()) == 600
    assert 0 < sum(r["rejected"] for r in found.values())


def test_a_batch_that_runs_again_leaves_the_same_state(spark, tmp_path):
    components = [{"label": 0, "mean": np.zeros(2), "cov": np.eye(2)}]
    steps = SteppedState(spark, str(tmp_path), state_rows(spark, components), Following(threshold=100.0, half_life=2).step)
    frames = [spark.createDataFrame([(k, v) for v in vectors(k, 30, 2)], "window_id bigint, z array<double>") for k in range(2)]
    for batch, frame in enumerate(frames):
        steps.process(frame, batch)
    once = sorted(map(tuple, steps.reports().collect()), key=str)
    steps.process(frames[1], 1)
    assert sorted(map(tuple, steps.reports().collect()), key=str) == once
    assert steps.state().first()["steps"] == 2


def test_a_singular_covariance_has_a_factor(spark, tmp_path):
    flat = np.ones((3, 3))
    for cov in (flat, flat - 2e-6 * np.eye(3), np.diag([1.0, 1.0, -1.0]), np.zeros((3, 3))):
        f = factor(cov)
        assert np.isfinite(f).all() and (np.diag(f) > 0).all()
    components = [{"label": 0, "mean": np.zeros(3), "cov": flat - 1e-3 * np.eye(3)}]
    steps = SteppedState(spark, str(tmp_path), state_rows(spark, components), Following(threshold=1e12).step)
    steps.process(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "window_id bigint, z array<double>"), 0)
    assert steps.state().first()["n_updates"] == 1
    with pytest.raises(ValueError):
        factor(np.full((2, 2), np.nan))


def test_thresholds_step_by_segment_with_a_bounded_buffer(spark, tmp_path):
    rnd = np.random.default_rng(6)
    rows = [(w, s, float(rnd.normal(loc=w)), k) for w in range(4) for k, s in enumerate(rnd.choice(["a", "b"], 40))]
    first = spark.createDataFrame([("a", 0.05, []), ("b", 0.05, [0.5])], "segment string, alpha double, scores array<double>")
    step = lambda now, new, _: threshold_step(now, new, ["k"], target=0.05, gamma=0.02, buffer=25)
    steps = SteppedState(spark, str(tmp_path), first, step)
    steps.process(spark.createDataFrame(rows, "window_id bigint, segment string, score double, k bigint").repartition(5), 0)
    found = {(r["window"], r["segment"]): r for r in steps.reports().collect()}
    for s, scores in (("a", []), ("b", [0.5])):
        alpha = 0.05
        for w in range(4):
            new = [r[2] for r in rows if r[0] == w and r[1] == s]
            cut = np.percentile(scores, 100 * (1 - min(max(alpha, 1e-4), 0.5))) if scores else np.inf
            over = np.mean(np.array(new) > cut)
            alpha = float(np.clip(alpha + 0.02 * (0.05 - (over > 0.05)), 1e-4, 0.5))
            scores = (scores + new)[-25:]
            row = found[w, s]
            assert row["threshold"] == pytest.approx(cut) and row["alpha"] == pytest.approx(alpha)
            assert row["scores"] == scores and row["n_reference"] == len(new)
