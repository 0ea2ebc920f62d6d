"""Clusters inside every class at once, and the moments of the clusters.

One pass over the vectors serves all classes: every task assigns its vectors to the nearest
centre of their own class and adds them up, so one row per task and cluster is shuffled, whatever
the size of a class. The centres, a small table of checked size, are all that the driver holds
between rounds.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_BYTES = 64 << 20
Centres = dict[int, np.ndarray]  # class: one row per centre


def arrow_vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every vector; of equals, the first."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(centres) > 1 else np.zeros(len(x), np.int64)


def _by_class(labels: np.ndarray, x: np.ndarray, centres: Centres, block: int = 4096) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, cluster, vectors), block by block."""
    for at in range(0, len(x), block):
        own, vectors = labels[at : at + block], x[at : at + block]
        for c in np.unique(own):
            if int(c) in centres:
                rows = vectors[own == c]
                place = nearest(rows, centres[int(c)])
                for j in np.unique(place):
                    yield int(c), int(j), rows[place == j]


def _checked(centres: Centres) -> Centres:
    held = sum(c.nbytes for c in centres.values())
    if held > MAX_BYTES:
        raise ValueError(f"the centres hold {held} bytes; the driver keeps at most {MAX_BYTES}")
    return centres


def cluster_sums(rows: DataFrame, column: str, label: str, centres: Centres) -> dict[tuple[int, int], tuple]:
    """Of each (class, cluster): number of vectors, their sum and the sum of their squares, relative
    to the centre."""
    dim = next(iter(centres.values())).shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for c, j, x in _by_class(batch.column(0).to_numpy(), arrow_vectors(batch.column(1), dim), centres):
                x = x - centres[c][j]
                held = sums.setdefault((c, j), [0, np.zeros(dim), np.zeros(dim)])
                held[0] += len(x)
                held[1] += x.sum(0)
                held[2] += (x * x).sum(0)
        keys = list(sums)
        yield pa.record_batch(
            [pa.array([c for c, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()),
             pa.array([sums[k][0] for k in keys], pa.int64()),
             *[pa.array([sums[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in (1, 2)]],
            names=["c", "j", "n", "s", "q"],
        )

    parts = rows.select(F.col(label).cast("int"), F.col(column)).mapInArrow(
        partial, "c int, j int, n bigint, s array<double>, q array<double>"
    )
    add = lambda name: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(dim)])
    totals = parts.groupBy("c", "j").agg(F.sum("n").alias("n"), add("s").alias("s"), add("q").alias("q"))
    return {(r["c"], r["j"]): (r["n"], np.array(r["s"]), np.array(r["q"])) for r in totals.collect()}


def _moved(centres: Centres, sums: dict) -> Centres:
    """Means of the clusters; a centre that no vector is nearest to stays."""
    return {
        c: np.stack([m + sums[c, j][1] / sums[c, j][0] if (c, j) in sums else m for j, m in enumerate(own)])
        for c, own in centres.items()
    }


def class_centres(rows: DataFrame, column: str, label: str, dim: int, k: dict[int, int], rounds: int = 20) -> Centres:
    """Centres of ``k[class]`` clusters for every class, by rounds of k-means over all classes
    together.

    A class starts from its mean. While it has too few centres, that of the cluster with the largest
    sum of squares is replaced by two, one standard deviation to both sides along its widest axis.
    Then all classes are moved until no centre changes, at most ``rounds`` times."""
    centres = _checked({c: np.zeros((1, dim)) for c in k})
    centres = _moved(centres, cluster_sums(rows, column, label, centres))
    while any(len(centres[c]) < k[c] for c in k):
        sums = cluster_sums(rows, column, label, centres)
        for c in [c for c in k if len(centres[c]) < k[c]]:
            spread = {j: sums[c, j] for j in range(len(centres[c])) if (c, j) in sums}
            j = max(spread, key=lambda j: (spread[j][2].sum() - (spread[j][1] ** 2).sum() / spread[j][0], -j))
            n, s, q = spread[j]
            var = q / n - (s / n) ** 2
            step = np.zeros(dim)
            step[var.argmax()] = np.sqrt(max(var.max(), 0.0))
            mean = centres[c][j] + s / n
            centres[c] = np.concatenate([centres[c][:j], [mean - step, mean + step], centres[c][j + 1 :]])
        _checked(centres)
    if any(n > 1 for n in k.values()):
        for _ in range(rounds):
            after = _moved(centres, cluster_sums(rows, column, label, centres))
            if all(np.array_equal(after[c], centres[c]) for c in k):
                break
            centres = after
    return centres


def cluster_moments(rows: DataFrame, column: str, label: str, centres: Centres) -> dict[tuple[int, int], tuple]:
    """Of each (class, cluster) of the nearest centre: n, mean, sum of outer products and sum of
    squared squared lengths, both about the mean. One row per task, cluster and matrix row is shuffled."""
    dim = next(iter(centres.values())).shape[1]
    first = cluster_sums(rows, column, label, centres)
    means = {(c, j): centres[c][j] + s / n for (c, j), (n, s, _) in first.items()}
    held = len(means) * dim * dim * 8
    if held > 16 * MAX_BYTES:
        raise ValueError(f"the matrices of {len(means)} clusters hold {held} bytes")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for c, j, x in _by_class(batch.column(0).to_numpy(), arrow_vectors(batch.column(1), dim), centres):
                x = x - means[c, j]
                of = sums.setdefault((c, j), [np.zeros((dim, dim)), 0.0])
                of[0] += x.T @ x
                of[1] += float(((x * x).sum(1) ** 2).sum())
        for (c, j), (ss, q) in sums.items():
            yield pa.record_batch(
                [pa.array([c] * dim, pa.int32()), pa.array([j] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                 pa.array([q] + [0.0] * (dim - 1)), pa.array(ss.tolist(), pa.list_(pa.float64()))],
                names=["c", "j", "i", "q", "row"],
            )

    parts = rows.select(F.col(label).cast("int"), F.col(column)).mapInArrow(
        partial, "c int, j int, i int, q double, row array<double>"
    )
    add = F.array(*[F.sum(F.get("row", F.lit(i))) for i in range(dim)])
    out = {key: [first[key][0], means[key], np.zeros((dim, dim)), 0.0] for key in means}
    for r in parts.groupBy("c", "j", "i").agg(F.sum("q").alias("q"), add.alias("row")).collect():
        of = out[r["c"], r["j"]]
        of[2][r["i"]] = r["row"]
        of[3] += r["q"]
    return {key: tuple(of) for key, of in out.items()}


@dataclass
class ClassMixture:
    """Components as dicts {label, cluster, n, mean, cov, cov0, weight}, and what was left out:
    {label, cluster, n, reason}, with a null cluster for a whole class."""

    components: list[dict]
    skipped: list[dict] = field(default_factory=list)


def fit_classes(
    df: DataFrame, column: str, label: str, dim: int, k: int, min_samples: int,
    covariance: Callable[[int, np.ndarray, float], np.ndarray],
) -> ClassMixture:
    """A component for each of ``k`` clusters of every class. A class of fewer than ``min_samples``
    vectors, and a cluster of fewer, are left out and listed; a class of fewer than ``k`` times as
    many is one cluster. Rows with a null label or vector belong to no class."""
    from flowloom.workspace import materialize

    known = F.col(label).isNotNull() & F.col(column).isNotNull()
    rows = materialize(df.where(known).select(F.col(label), F.col(column).cast("array<double>").alias(column)), "class-vectors")
    sizes = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    skipped = [
        {"label": c, "cluster": None, "n": n, "reason": "few vectors of the class"} for c, n in sorted(sizes.items()) if n < min_samples
    ]
    counts = {c: k if n >= k * min_samples else 1 for c, n in sizes.items() if n >= min_samples}
    if not counts:
        raise ValueError("no class has enough samples")
    centres = class_centres(rows, column, label, dim, counts)
    components, total = [], sum(sizes.values())
    for (c, j), (n, mean, ss, q) in sorted(cluster_moments(rows, column, label, centres).items()):
        if n < min_samples:
            skipped.append({"label": c, "cluster": j, "n": n, "reason": "few vectors of the cluster"})
            continue
        cov = covariance(n, ss, q).tolist()
        components.append({"label": c, "cluster": j, "n": n, "mean": mean.tolist(), "cov": cov, "cov0": cov, "weight": n / total})
    return ClassMixture(components, skipped)
