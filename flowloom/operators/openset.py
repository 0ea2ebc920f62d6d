"""Open-set scoring: projections, class mixtures, distances, negatives."""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from flowloom.operators.clusters import ClassMixture, fit_classes
from flowloom.operators.ordered import exact_percentiles, row_ranks
from flowloom.workspace import checked_broadcast


# ------------------------------------------------------------------ projections
def vector_mean(df: DataFrame, column: str, dim: int) -> np.ndarray:
    row = df.agg(*[F.avg(F.get(column, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)]).first()
    return np.array([row[i] for i in range(dim)])


def random_basis(dim: int, out_dim: int, seed: int = 0) -> np.ndarray:
    """Orthonormal columns; the matrix is dim x out_dim and independent of the data."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, out_dim)))
    return q[:, :out_dim]


def pca_basis(df: DataFrame, column: str, out_dim: int) -> np.ndarray:
    model = PCA(k=out_dim, inputCol="_v", outputCol="_p").fit(
        df.select(array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    )
    return model.pc.toArray()


def project(df: DataFrame, column: str, mean: np.ndarray, basis: np.ndarray, out: str = "z") -> DataFrame:
    """(x - mean) W as array expressions; the basis is a small constant."""
    x = F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    centred = df.withColumn("_x", x)
    dots = [
        F.aggregate(
            F.zip_with("_x", F.array(*[F.lit(float(w)) for w in basis[:, j]]), lambda a, b: a * b),
            F.lit(0.0), lambda acc, v: acc + v,
        )
        for j in range(basis.shape[1])
    ]
    return centred.withColumn(out, F.array(*dots)).drop("_x")


# --------------------------------------------------------------------- mixture
def moment_sums(df: DataFrame, key: str, column: str, dim: int, centres: dict | None = None) -> DataFrame:
    """(key, n, s, ss, q): counts, vector sums, outer-product sums and sums of squared
    lengths squared. Every task first adds up its own rows, so one row per task and
    component is shuffled."""
    pairs = dim * dim

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, list] = {}
        for pdf in frames:
            for k, group in pdf.groupby("k"):
                x = np.stack(group["x"].to_numpy()).astype(float)
                if centres is not None:
                    x = x - centres[int(k)]
                a = acc.setdefault(int(k), [0, np.zeros(dim), np.zeros((dim, dim)), 0.0])
                a[0] += len(x)
                a[1] += x.sum(0)
                a[2] += x.T @ x
                a[3] += float(((x * x).sum(1) ** 2).sum())
        yield pd.DataFrame(
            [(k, n, s.tolist(), ss.ravel().tolist(), q) for k, (n, s, ss, q) in acc.items()],
            columns=["k", "n", "s", "ss", "q"],
        )

    parts = df.select(F.col(key).cast("int").alias("k"), F.col(column).alias("x")).mapInPandas(
        partial, "k int, n bigint, s array<double>, ss array<double>, q double"
    )
    add = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])
    return parts.groupBy("k").agg(
        F.sum("n").alias("n"), add("s", dim).alias("s"), add("ss", pairs).alias("ss"), F.sum("q").alias("q")
    ).withColumnRenamed("k", key)


def shrunk_covariance(n: int, ss: np.ndarray, q: float) -> np.ndarray:
    """Ledoit-Wolf from centred sums: the sample covariance pulled towards a multiple of the
    identity by the estimated share."""
    d = ss.shape[0]
    s = ss / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min((q / n - (s ** 2).sum()) / (n * d), delta)
    share = 0.0 if delta == 0 else max(beta, 0.0) / delta
    return (1 - share) * s + share * mu * np.eye(d)


def fit_class_mixture(df: DataFrame, column: str, label: str, dim: int, k: int = 2, min_samples: int = 20,
                      floor: float = 1e-6) -> ClassMixture:
    """Clusters inside every class with shrunk covariances, and the classes and clusters that had
    too few vectors for one."""
    shrunk = lambda n, ss, q: shrunk_covariance(n, ss, q) + floor * np.eye(dim)
    return fit_classes(df, column, label, dim, k, min_samples, shrunk)


def fit_mixture(df: DataFrame, column: str, label: str, dim: int, k: int = 2, min_samples: int = 20) -> list[dict]:
    """The components of :func:`fit_class_mixture`."""
    return fit_class_mixture(df, column, label, dim, k, min_samples).components


def mahalanobis(df: DataFrame, column: str, components: list[dict], out: str = "distance") -> DataFrame:
    """Adds the smallest squared distance, its component, and the smallest per class."""
    means = [np.array(c["mean"]) for c in components]
    factors = [np.linalg.inv(np.linalg.cholesky(np.array(c["cov"]))) for c in components]
    labels = np.array([c["label"] for c in components])
    classes = int(labels.max()) + 1

    @F.pandas_udf("distance double, component int, per_class array<double>")
    def solve(z: pd.Series) -> pd.DataFrame:
        x = np.stack(z.to_numpy()).astype(float) if len(z) else np.zeros((0, len(means[0])))
        d2 = np.stack([(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(means, factors)], axis=1)
        per = np.full((len(x), classes), np.inf)
        for j, c in enumerate(labels):
            per[:, c] = np.minimum(per[:, c], d2[:, j])
        return pd.DataFrame({"distance": d2.min(1), "component": d2.argmin(1).astype("int32"), "per_class": list(per)})

    scored = df.withColumn("_d", solve(F.col(column)))
    return scored.withColumns({
        out: F.col("_d.distance"), "component": F.col("_d.component"), "per_class": F.col("_d.per_class"),
    }).drop("_d")


def acceptance_threshold(scored: DataFrame, percentile: float = 95.0, column: str = "distance") -> DataFrame:
    return exact_percentiles(scored, [], [column], [percentile / 100.0]).select(F.col("value").alias("threshold"))


def accepted_sums(scored: DataFrame, column: str, dim: int, threshold: float) -> DataFrame:
    """Sums of the vectors inside the gate per nearest component, for ``gated_update``."""
    inside = scored.where(F.col("distance") <= threshold)
    return moment_sums(inside, "component", column, dim)


# ------------------------------------------------------------------- negatives
def negative_pairs(edges: DataFrame, tie: list[str], seed: int = 0, key: str = "window_id") -> DataFrame:
    """As many pairs per window as edges: the source comes from the window's own sources in
    another random order, so degrees match; the target is any host of the window. Pairs with
    equal ends are dropped."""
    a = row_ranks(edges.select(key, "src", *tie), [key], [F.xxhash64(*tie, F.lit(seed)), *[F.col(c) for c in tie]], "_r")
    hosts = edges.select(key, F.explode(F.array("src", "dst")).alias("host")).distinct()
    sizes = checked_broadcast(hosts.groupBy(key).agg(F.count(F.lit(1)).alias("_hosts")), "window-hosts")
    ranked = row_ranks(hosts, [key], [F.col("host")], "_h")
    pick = F.pmod(F.xxhash64(*tie, F.lit(seed + 1)), F.col("_hosts")).alias("_h")
    drawn = a.join(sizes, key).select(key, F.col("_r").alias("rank"), "src", pick)
    pairs = drawn.join(ranked, [key, "_h"]).select(key, "rank", "src", F.col("host").alias("dst"))
    return pairs.where(F.col("src") != F.col("dst"))
