"""Percentiles by selection against numpy."""

import random

import numpy as np
import pytest

from flowloom.operators import ordered

PROBS = [0.0, 0.001, 0.01, 0.25, 0.45, 0.5, 0.95, 0.999, 1.0]


def check(spark, rows, keys, monkeypatch=None):
    df = spark.createDataFrame(rows, "g string, h int, a double, b int").repartition(7)
    found = {(*[r[k] for k in keys], r["column"], r["prob"]): r["value"] for r in ordered.exact_percentiles(df, keys, ["a", "b"], PROBS).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(tuple({"g": r[0], "h": r[1]}[k] for k in keys), []).append(r)
    want = {}
    for key, own in groups.items():
        for column, at in (("a", 2), ("b", 3)):
            values = [r[at] for r in own if r[at] is not None]
            for p in PROBS if values else []:
                want[(*key, column, p)] = float(np.quantile(np.array(values, float), p))
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=1e-9, nan_ok=True), k


def rows(seed, n):
    rnd = random.Random(seed)
    out = [(rnd.choice(["x", "y", "y", None]), rnd.randrange(3), rnd.choice([None, 0.0, 0.0, round(rnd.gauss(0, 5), 2), rnd.random()]), rnd.randrange(40)) for _ in range(n)]
    return out + [("one", 0, 1.5, 7), ("two", 1, 1.0, 1), ("two", 1, 2.0, 3), ("none", 2, None, 5), ("same", 0, 4.0, None), ("same", 0, 4.0, None)]


@pytest.mark.parametrize("sketch,n", [(20_000, 3000), (100, 3000), (20, 500), (20_000, 13)])
def test_quantiles_match_numpy(spark, monkeypatch, sketch, n):
    monkeypatch.setattr(ordered, "SKETCH", sketch)
    for keys in ([], ["g"], ["g", "h"]):
        check(spark, rows(n, n), keys)


def test_brackets_that_miss_are_seen(spark, monkeypatch):
    """A sketch that is far off gives no bracket; the histogram is ranked instead."""
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda c, cuts, _: ordered.F.transform(cuts, lambda x: ordered.F.lit(1e6)))
    check(spark, rows(3, 200), ["g"])


def test_nan_is_the_largest_value(spark):
    data = spark.createDataFrame([(float(k),) for k in range(9)] + [(float("nan"),)], "a double")
    (top,) = ordered.exact_percentiles(data, [], ["a"], [1.0]).collect()
    assert np.isnan(top["value"])


def test_an_empty_table_has_no_percentiles(spark):
    none = spark.createDataFrame([], "g string, a double")
    assert ordered.exact_percentiles(none, ["g"], ["a"], [0.5]).collect() == []
    assert ordered.exact_percentiles(none, [], ["a"], [0.5]).collect() == []
