"""Class-wise clusters against the same rounds in plain numpy."""

import numpy as np
import pytest

from flowloom.operators import openset
from flowloom.operators.clusters import class_centres, nearest
from pyspark.sql import functions as F


def plain_centres(x, k, rounds=20):
    centres = x.mean(0, keepdims=True)
    while len(centres) < k:
        place = nearest(x, centres)
        squares = [((x[place == j] - x[place == j].mean(0)) ** 2).sum() if (place == j).any() else -1 for j in range(len(centres))]
        j = int(np.argmax(squares))
        own, step = x[place == j], np.zeros(x.shape[1])
        step[own.var(0).argmax()] = own.std(0).max()
        centres = np.concatenate([centres[:j], [own.mean(0) - step, own.mean(0) + step], centres[j + 1 :]])
    for _ in range(rounds if k > 1 else 0):
        place = nearest(x, centres)
        centres = np.stack([x[place == j].mean(0) if (place == j).any() else centres[j] for j in range(k)])
    return centres


def classes(seed, sizes, d):
    rnd = np.random.default_rng(seed)
    out = {}
    for c, n in sizes.items():
        middle = rnd.standard_normal((3, d)) * 5
        out[c] = middle[rnd.integers(0, 3, n)] + rnd.standard_normal((n, d))
    return out


def frame(spark, data):
    rows = [(c, x.tolist()) for c, own in data.items() for x in own]
    return spark.createDataFrame(rows + [(None, [0.0]), (1, None)], "label int, z array<double>").repartition(5)


@pytest.mark.parametrize("d,k", [(4, 1), (4, 3), (64, 2), (384, 2)])
def test_components_match_a_fold(spark, d, k):
    data = classes(d, {0: 300, 1: 90, 3: 41, 4: 19, 7: 200}, d)
    fit = openset.fit_class_mixture(frame(spark, data), "z", "label", d, k=k, min_samples=20)
    want, left_out = [], [(4, None, 19)]
    for c, x in data.items():
        if len(x) < 20:
            continue
        centres = plain_centres(x, k if len(x) >= k * 20 else 1)
        place = nearest(x, centres)
        for j in range(len(centres)):
            own = x[place == j]
            if len(own) >= 20:
                want.append((c, j, len(own), own.mean(0), own))
            elif len(own):
                left_out.append((c, j, len(own)))
    assert [(s["label"], s["cluster"], s["n"]) for s in fit.skipped] == left_out and all(s["reason"] for s in fit.skipped)
    assert [(c["label"], c["cluster"], c["n"]) for c in fit.components] == [w[:3] for w in want]
    for c, (_, _, n, mean, own) in zip(fit.components, want, strict=True):
        np.testing.assert_allclose(c["mean"], mean, atol=1e-9)
        y = own - mean
        cov = openset.shrunk_covariance(n, y.T @ y, float(((y * y).sum(1) ** 2).sum())) + 1e-6 * np.eye(d)
        np.testing.assert_allclose(np.array(c["cov"]), cov, atol=1e-8)
        assert c["weight"] == pytest.approx(n / 650)


def test_repeated_vectors_and_empty_tables(spark):
    same = spark.createDataFrame([(0, [1.0, 2.0])] * 50, "label int, z array<double>")
    fit = openset.fit_class_mixture(same, "z", "label", 2, k=2, min_samples=20)
    assert [c["n"] for c in fit.components] == [50]  # equal vectors are one cluster
    centres = class_centres(same, "z", "label", 2, {0: 2})
    assert np.array_equal(centres[0], [[1.0, 2.0], [1.0, 2.0]])
    with pytest.raises(ValueError):
        openset.fit_class_mixture(same.where(F.lit(False)), "z", "label", 2)
