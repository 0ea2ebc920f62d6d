"""Toxicity by nearest labelled examples, under exact TF-IDF cosine.

A bounded sample of labelled rows is the set of examples. Its terms are lower-cased words and
their first four and five letters (suffixes vary more than stems); those that go with either
label beyond chance make up the vocabulary. The examples' vectors form an inverted index whose
lists are cut into blocks of neighbouring examples, each with its largest weight. A text's
nearest examples are found block by block, from the highest possible cosine down, until no
unseen block can hold a nearer one: the search is exact. Votes are weighted by cosine, set
against the prior, and mapped to probabilities by a curve fitted on the examples themselves,
each scored without its own copies.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowloom.llm.base import byte_views, quoted
from flowloom.workspace import materialize

#: ASCII other than letters, digits, and bytes of wider characters separate words.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
STEMS = (4, 5)
REMEMBERED = 200_000  # words whose terms a worker keeps


def words(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(SPLIT).split()


def terms_of(word: bytes) -> list[str]:
    """The word and its stems, marked by a star."""
    letters = word.decode()
    return [letters, *(f"{letters[:n]}*" for n in STEMS if len(letters) > n)]


def term_counts(text: bytes) -> Counter:
    found = Counter()
    for word, n in Counter(words(text)).items():
        for term in terms_of(word):
            found[term] += n
    return found


class Index:
    """TF-IDF vectors of labelled examples in block-max inverted lists."""

    def __init__(self, vocabulary: dict[str, float], examples: list[dict[str, int]], labels, ids, block: int = 64):
        self.idf = np.array(list(vocabulary.values()), np.float64)
        self.number = {term: k for k, term in enumerate(vocabulary)}
        self.labels, self.ids, self.block = np.asarray(labels, np.float64), np.asarray(ids), block
        self.prior = float(self.labels.mean()) if len(self.labels) else 0.0
        rows = [self.vector(Counter({self.number[t]: n for t, n in x.items() if t in self.number})) for x in examples]
        term = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        order = np.lexsort((example, term))
        self.term, self.example, self.weight = term[order], example[order], weight[order]
        # One entry for each (term, block) that has postings.
        cell = self.term * (1 << 32) + self.example // block
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.cell_start = np.append(begin, len(cell))
        self.cell_block = self.example[begin] // block
        self.cell_max = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.cells_of = np.searchsorted(self.term[begin], np.arange(len(self.idf) + 1))
        self.size, self.blocks = len(rows), -(-len(rows) // block)
        self._rows = rows

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; both are empty without known terms."""
        known = np.array(sorted(counts), np.int64)
        weight = (1 + np.log([counts[k] for k in known.tolist()] or np.zeros(0))) * self.idf[known]
        norm = np.sqrt((weight**2).sum())
        return known, weight / norm if norm else weight

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1):
        """The ``k`` examples of highest positive cosine, ties to the earlier example."""
        low, high = self.cells_of[terms], self.cells_of[terms + 1]
        count = high - low
        cells = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        query = np.repeat(weights, count)
        bound = np.bincount(self.cell_block[cells], query * self.cell_max[cells], self.blocks)
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, 4
        while at < len(ranked):
            if len(cosine) == k and bound[ranked[at]] < cosine[-1] - 1e-9:
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[ranked[at : at + take]] = True
            at, take = at + take, 2 * take
            used = chosen[self.cell_block[cells]]
            first, size = self.cell_start[cells[used]], np.diff(self.cell_start)[cells[used]]
            where = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            example = self.example[where]
            seen, which = np.unique(example, return_inverse=True)
            score = np.bincount(which, np.repeat(query[used], size) * self.weight[where])
            keep = seen != without
            best, cosine = np.concatenate([best, seen[keep]]), np.concatenate([cosine, score[keep]])
            order = np.lexsort((best, -cosine))[:k]
            best, cosine = best[order], cosine[order]
        return best, np.minimum(cosine, 1.0)

    def row(self, example: int) -> tuple[np.ndarray, np.ndarray]:
        return self._rows[example]

    def vote(self, best: np.ndarray, cosine: np.ndarray, doubt: float) -> float:
        """Share of toxic neighbours by weight, with the prior as ``doubt`` more votes."""
        weight = cosine**2
        return float((doubt * self.prior + (weight * self.labels[best]).sum()) / (doubt + weight.sum()))


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from votes to probabilities. Targets are drawn in by
    the usual prior counts, so that separable examples give a finite slope."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 4.0, -2.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * votes + b, -30, 30)))
        slope, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(slope * votes).sum() + 1e-3 * a, slope.sum()])
        h = np.array([[(w * votes**2).sum() + 1e-3, (w * votes).sum()], [(w * votes).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


class Model:
    """An index with its votes and curve."""

    def __init__(self, index: Index, k: int, doubt: float, fitted_on: int):
        self.index, self.k, self.doubt = index, k, doubt
        n = min(fitted_on, index.size)
        alone = [index.vote(*index.nearest(*index.row(e), k, without=e), doubt) for e in range(n)]
        self.curve = fit_curve(np.array(alone), index.labels[:n]) if n else (0.0, -30.0)

    def score(self, counts: Counter) -> tuple[float, np.ndarray, np.ndarray]:
        best, cosine = self.index.nearest(*self.index.vector(counts), self.k)
        a, b = self.curve
        x = a * self.index.vote(best, cosine, self.doubt) + b
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), best, cosine


class Known(dict):
    """Words to the numbers of their terms in the vocabulary, worked out once per word."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        self[word] = found
        return found


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(bytes(x)) for x in byte_views(batch.column(1))]
        size = [len(x) for x in found]
        yield pa.record_batch(
            [pa.array(np.repeat(batch.column(0).to_numpy(), size)),
             pa.array([t for x in found for t in x], pa.string()),
             pa.array([n for x in found for n in x.values()], pa.int64())],
            names=["example", "term", "n"],
        )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_examples: int = 6_000, k: int = 15,
    doubt: float = 1.0, least: int = 5, chance: float = 50.0, fitted_on: int = 2_000,
) -> Model:
    """Fit on at most ``max_examples`` labelled rows, taken in the order of a hash of the id;
    what reaches the driver is bounded by that number of texts.

    An id labelled twice counts as toxic if any row says so; null ids and null labels are left
    out; equal texts are one example, with the label of the first. Without examples every score
    is 0. Terms in under ``least`` examples, or whose chi-square with the label is not above
    ``chance``, stay out of the vocabulary.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_examples)
    )
    # At most ``max_examples`` narrow rows: small enough to send to every executor.
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    held = materialize(texts.join(F.broadcast(picked), "_id"), "examples")
    first = held.groupBy(F.xxhash64("_text").alias("_digest")).agg(
        F.min(F.struct("_order", "_id")).alias("_first"), F.min_by("_label", F.struct("_order", "_id")).alias("_label")
    )
    chosen = first.orderBy("_first").select("_first._id", "_label").collect()
    number = {row[0]: e for e, row in enumerate(chosen)}
    firsts = first.select("_digest", F.col("_first._id").alias("_id"), "_label")
    examples = held.drop("_label").withColumn("_digest", F.xxhash64("_text")).join(
        F.broadcast(firsts), ["_digest", "_id"]
    )
    counts = materialize(
        examples.select(F.col("_id"), "_text")
        .mapInArrow(_example_terms, "example bigint, term string, n bigint")
        .dropDuplicates(["example", "term"])  # rows may repeat
        .join(F.broadcast(firsts.select(F.col("_id").alias("example"), "_label")), "example"),
        "example-terms",
    )
    n, n_toxic = len(chosen), sum(row[1] for row in chosen)
    table = (
        counts.groupBy("term").agg(F.count("*").alias("both"), F.sum("_label").alias("toxic"))
        .where(F.col("both") >= least)
    )
    expected = F.col("both") * n_toxic / max(n, 1)
    spread = F.greatest(expected * (1 - n_toxic / max(n, 1)) * (1 - F.col("both") / max(n, 1)), F.lit(1e-9))
    departs = table.withColumn("chi", F.pow(F.col("toxic") - expected, 2) / spread).where(F.col("chi") > chance)
    chosen_terms = departs.select("term", "both")
    both = dict(sorted((r.term, r.both) for r in chosen_terms.collect()))
    vectors: list[dict[str, int]] = [{} for _ in chosen]
    kept = counts.join(F.broadcast(chosen_terms.select("term")), "term", "left_semi")
    for row in kept.select("example", "term", "n").collect():
        vectors[number[row.example]][row.term] = row.n
    idf = {term: float(np.log((1 + n) / (1 + b)) + 1) for term, b in both.items()}
    return Model(Index(idf, vectors, [r[1] for r in chosen], [r[0] for r in chosen]), k, doubt, fitted_on)


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", evidence: int = 3) -> DataFrame:
    """``columns`` of every row, with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on), and the
    nearest examples as ``evidence_ids`` and ``evidence_cosines``. A text without known terms,
    null and empty ones included, has no evidence and the score that the prior maps to. Rows
    repeat as given; an empty table gives an empty result."""
    picked = docs.select(F.col(text_col).alias("_text"), F.struct(*map(quoted, columns)).alias("_row"))
    numbers = T.StructType.fromDDL("score double, evidence_ids array<bigint>, evidence_cosines array<double>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.index.number)
        for batch in batches:
            scores, ids, cosines = [], [], []
            for text in byte_views(batch.column(0)):
                counts = Counter()
                for found in map(known.__getitem__, words(bytes(text))):
                    if found:
                        counts.update(found)
                value, best, cosine = model.score(counts)
                scores.append(value)
                ids.append(model.index.ids[best[:evidence]].tolist())
                cosines.append(cosine[:evidence].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(cosines, pa.list_(pa.float64()))],
                names=["_row", "score", "evidence_ids", "evidence_cosines"],
            )

    scored = picked.mapInArrow(work, T.StructType([picked.schema["_row"], *numbers.fields]))
    return scored.select(
        *[F.col("_row")[c].alias(c) for c in columns], "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines",
    )
