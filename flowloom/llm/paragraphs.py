"""Repeated paragraphs by MinHash banding, exact verification and components.

A paragraph is a line of at least ``least`` words. Equal paragraphs form a class. Classes whose
MinHash signatures agree in a band are candidates: each is first compared with one member of its
bucket that a combining aggregate picks, another for every bucket, so families of near copies
connect without pairs inside a group. What is then left in different components is joined
exactly, on the rarest word runs of each paragraph, so no candidate pair is left out.
Jaccard similarity is computed exactly on sets of word runs. One paragraph of a component stays.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.base import release, text_or_empty
from flowloom.llm.components import components
from flowloom.llm.set_join import prefix_items
from flowloom.llm.token_files import flat_texts
from flowloom.llm.words import NEWLINE, blocks, mix, runs, word_ids
from flowloom.workspace import materialize


def tune_bands(threshold: float, recall: float = 0.999, doubt: float = 0.5) -> tuple[int, int]:
    """(bands, rows in a band): the shortest bands for which pairs at ``threshold`` collide with
    probability ``recall`` or more, while pairs at half the threshold do so with at most
    ``doubt``. Fewer rows need fewer bands for the same recall."""
    for rows in range(1, 20):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= doubt:
            return bands, rows
    return bands, rows


class Paragraphs:
    """The paragraphs of some texts: text, number of its line, words and their identifiers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, width: int):
        inner = offsets[1:-1] - offsets[0]
        stretch = np.insert(data[offsets[0] : offsets[-1]], inner, NEWLINE)
        begin = np.concatenate([[0], inner + np.arange(1, len(inner) + 1)])
        starts, ids = word_ids(stretch)
        lines = np.concatenate([[0], np.flatnonzero(stretch == NEWLINE) + 1])
        line = np.searchsorted(lines, starts, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(line)))
        keep = count >= max(least, width)
        self.first, self.count, self.ids = first[keep], count[keep], ids
        number = line[self.first]
        self.text = np.searchsorted(begin, lines[number], "right") - 1
        self.number = number - np.searchsorted(lines, begin[self.text], "left")
        self.stretch, self.line_begin = stretch, lines[number]
        self.line_end = np.append(lines[1:] - 1, len(stretch))[number]
        # Equal sequences of words have equal identifiers: a sum over words and their places.
        self.words = np.repeat(self.first - (np.cumsum(self.count) - self.count), self.count) + np.arange(self.count.sum())
        place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        value = mix(ids[self.words] + mix(place.astype(np.uint64) + np.uint64(1)))
        start = np.cumsum(self.count) - self.count
        self.digest = mix(np.add.reduceat(value, start)) if len(start) else np.zeros(0, np.uint64)
        # Runs of words inside a paragraph.
        size = self.count - width + 1
        self.run_start = np.cumsum(size) - size
        where = np.repeat(self.first - self.run_start, size) + np.arange(size.sum())
        self.runs = runs(ids, width)[where] if len(where) else np.zeros(0, np.uint64)

    def bands(self, bands: int, rows: int, seed: int = 9) -> np.ndarray:
        """One key for every paragraph and band."""
        keys = np.zeros((len(self.first), bands), np.uint64)
        if len(self.first):
            random = np.random.default_rng(seed)
            for band in range(bands):
                key = np.full(len(self.first), np.uint64(band))
                for _ in range(rows):
                    a, b = random.integers(1, 1 << 63, 2).astype(np.uint64)
                    permuted = (self.runs ^ b) * (a * np.uint64(2) + np.uint64(1))
                    permuted ^= permuted >> np.uint64(32)
                    key = mix(key + np.minimum.reduceat(permuted, self.run_start))
                keys[:, band] = key
        return keys


def _scan(least: int, width: int, bands: int, rows: int):
    """Digests of all paragraphs, with band keys where the task sees a digest for the first time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            ids = batch.column(0)
            for lo, hi in blocks(offsets):
                found = Paragraphs(data, offsets[lo : hi + 1], least, width)
                keys = found.bands(bands, rows).view(np.int64).tolist()
                for k, digest in enumerate(found.digest.tolist()):
                    if digest in seen:
                        keys[k] = None
                    seen.add(digest)
                yield pa.record_batch(
                    [ids.take(pa.array(found.text + lo)), pa.array(found.number), pa.array(found.count),
                     pa.array(found.digest.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["_id", "number", "n_words", "digest", "keys"],
                )

    return work


def _lines(least: int, width: int):
    """Digest and line of all paragraphs, once per task and digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = flat_texts(batch.column(0))
            for lo, hi in blocks(offsets):
                found = Paragraphs(data, offsets[lo : hi + 1], least, width)
                new = []
                for k, digest in enumerate(found.digest.tolist()):
                    if digest not in seen:
                        seen.add(digest)
                        new.append(k)
                begin, end = found.line_begin[new].tolist(), found.line_end[new].tolist()
                lines = [bytes(found.stretch[a:b]) for a, b in zip(begin, end, strict=True)]
                yield pa.record_batch(
                    [pa.array(found.digest[new].view(np.int64)), pa.array(lines, pa.binary()).cast(pa.string())],
                    names=["digest", "line"],
                )

    return work


def _run_sets(least: int, width: int):
    """Sorted sets of the word runs of paragraphs given line by line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for lo, hi in blocks(offsets):
                found = Paragraphs(data, offsets[lo : hi + 1], least, width)
                ends = np.append(found.run_start[1:], len(found.runs))
                sets = [np.unique(found.runs[a:b]).view(np.int64) for a, b in zip(found.run_start, ends, strict=True)]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "runs"]
                )

    return work


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose sets have a Jaccard similarity of ``threshold`` or more."""
    left = sets.select(F.col("digest").alias("u"), F.col("runs").alias("_a"))
    right = sets.select(F.col("digest").alias("v"), F.col("runs").alias("_b"))
    small = F.least(F.size("_a"), F.size("_b"))
    large = F.greatest(F.size("_a"), F.size("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(left, "u").join(right, "v").where(small >= threshold * large)
        .where(common >= threshold * (F.size("_a") + F.size("_b") - common)).select("u", "v")
    )


def across_links(
    roots: np.ndarray, sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Pairs of members of different components whose sets are similar, as far as they connect
    components. Overlaps with one member are counted over the lists of its items, for all others
    at once; no pair is stored unless it is a link. With ``side``, members of side 0 are compared
    with those of side 1 only; members of side 2 with each other."""
    side = np.full(len(sets), 2) if side is None else side
    size = np.array([len(x) for x in sets])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(item, kind="stable")
    lists, start = member[order], np.searchsorted(item[order], np.arange(item.max() + 2))
    begin = np.cumsum(size) - size
    component = np.unique(roots, return_inverse=True)[1]
    us, vs = [], []
    for u in range(len(sets)):
        if (component == component[u]).all():
            break
        if side[u] == 1:
            continue
        own = item[begin[u] : begin[u] + size[u]]
        low, count = start[own], start[own + 1] - start[own]
        places = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(lists[places], minlength=len(sets))
        alike = (common >= threshold * (size[u] + size - common)) & (component != component[u])
        alike &= side == (2 if side[u] == 2 else 1)
        for v in np.flatnonzero(alike).tolist():
            if component[v] != component[u]:
                us.append(u)
                vs.append(v)
                component[component == component[v]] = component[u]
    return us, vs


MEMBERS = 1_000  # paragraphs of one item on each side of a group, on average


def item_groups(placed: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(item, kind, low, high, side, digest, root): groups in which all pairs of paragraphs of one
    item and different components meet. Of each item, the component with most paragraphs is not
    compared with itself: its parts meet parts of the rest (kind 0), and the rest meets itself
    part by part (kind 1). Parts are hashed, of about ``members`` paragraphs, so no group grows
    with the item."""
    by_root = placed.groupBy("item", "root").agg(F.count("*").alias("n"))
    parts = lambda n: F.ceil(n / members).cast("int")
    open_items = materialize(
        by_root.groupBy("item").agg(
            F.max(F.struct("n", "root")).alias("_main"), F.sum("n").alias("_all"), F.count("*").alias("_m")
        ).where(F.col("_m") > 1).select(
            "item", F.col("_main.root").alias("_main"), parts(F.col("_main.n")).alias("_parts"),
            parts(F.col("_all") - F.col("_main.n")).alias("_others"),
        ),
        "open-items",
    )

    def group(kind: int, low, high, side):
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))

    def each(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    own = F.col("_own")
    main = F.transform(each("_others"), lambda k: group(0, own, k, F.lit(0)))
    rest = F.concat(
        F.transform(each("_parts"), lambda k: group(0, k, own, F.lit(1))),
        F.transform(each("_others"), lambda k: group(
            1, F.least(own, k), F.greatest(own, k), F.when(own == k, 2).when(own < k, 0).otherwise(1))),
    )
    is_main = F.col("root") == F.col("_main")
    numbered = placed.join(open_items, "item").withColumn(
        "_own", F.pmod(F.xxhash64("digest"), F.when(is_main, F.col("_parts")).otherwise(F.col("_others"))).cast("int")
    )
    return numbered.select("item", "digest", "root", F.explode(F.when(is_main, main).otherwise(rest)).alias("_g")).select(
        "item", "_g.kind", "_g.low", "_g.high", "_g.side", "digest", "root"
    )


GROUP = ["item", "kind", "low", "high"]


def _links_across(threshold: float):
    """Links between components among the rows of one group, which are held until it ends."""

    def resolve(rows: list[tuple[int, int, int, np.ndarray]]) -> tuple[list[int], list[int]]:
        digests, roots, side, sets = zip(*rows, strict=True)
        us, vs = across_links(np.array(roots), list(sets), threshold, np.array(side))
        return [digests[k] for k in us], [digests[k] for k in vs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        us, vs = [], []
        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            side, digests, roots = (batch.column(k).to_pylist() for k in range(4, 7))
            for k, group in enumerate(groups):
                if group != last and held:
                    a, b = resolve(held)
                    us, vs, held = us + a, vs + b, []
                last = group
                held.append((digests[k], roots[k], side[k], batch.column(7)[k].values.to_numpy()))
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us, vs = [], []
        if held:
            a, b = resolve(held)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return work


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
    width: int = 5, least: int = 20, recall: float = 0.999,
) -> DataFrame:
    """One row for every paragraph to remove: id, ``paragraph`` (number of its line, from 0),
    ``n_words``, ``keeper_id`` and ``keeper_paragraph`` (the first of its component, by id and
    line), ``component``.

    Paragraphs whose sets of ``width``-word runs have a Jaccard similarity of ``threshold`` or
    more are linked; words are compared without case and punctuation. Lines under ``least``
    words are too short to be told from chance and stay. A null text has no paragraphs. A null
    id is smaller than all others; rows that share an id are one document. Without paragraphs
    the result is empty.
    """
    spark = docs.sparkSession
    bands, rows = tune_bands(threshold, recall)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.lower(text_or_empty(text_col)).alias("_text"))
    found = materialize(
        texts.mapInArrow(
            _scan(least, width, bands, rows),
            "_id bigint, number bigint, n_words bigint, digest bigint, keys array<bigint>",
        ),
        "paragraphs",
    )
    banded = found.where(F.col("keys").isNotNull()).select("digest", F.explode("keys").alias("key"))

    # One member of each bucket, chosen by an order that differs between buckets.
    order = F.col("digest").bitwiseXOR(F.col("key"))
    picks = banded.groupBy("key").agg(F.min(order).alias("_low"), F.max(order).alias("_high")).where(
        F.col("_low") != F.col("_high")
    ).select("key", "_low")
    members = materialize(
        banded.join(picks, "key").select("key", "digest", (order == F.col("_low")).alias("chosen")).distinct(),
        "bucket-members",
    )
    release(spark)
    chosen = members.where("chosen").select("key", F.col("digest").alias("v"))
    stars = (
        members.where(~F.col("chosen")).join(chosen, "key").select(F.col("digest").alias("u"), "v")
        .where(F.col("u") != F.col("v")).distinct()
    )
    sets = materialize(
        texts.select("_text").mapInArrow(_lines(least, width), "digest bigint, line string")
        .join(members.select("digest").distinct().hint("shuffle_hash"), "digest", "left_semi")
        .dropDuplicates(["digest"]).mapInArrow(_run_sets(least, width), "digest bigint, runs array<bigint>"),
        "run-sets",
    )
    release(spark)
    links = materialize(_verified(stars, sets, threshold), "star-links")
    roots = components(links)

    # Links between different components: an exact join of the sets on the runs that fewest have.
    # Runs that only one component has cannot add a link, however large it is.
    placed = materialize(
        prefix_items(sets, "digest", "runs", threshold)
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "item", "size", F.coalesce("root", "digest").alias("root")),
        "prefix-runs",
    )
    rest = item_groups(placed).join(sets, "digest").select(*GROUP, "side", "digest", "root", "runs")
    more = (
        rest.repartition(*GROUP).sortWithinPartitions(*GROUP, "digest")
        .mapInArrow(_links_across(threshold), "u bigint, v bigint")
    )
    roots = components(links.unionAll(more))

    # Components of one paragraph have nothing to remove.
    place = F.struct("_id", "number")
    classes = found.groupBy("digest").agg(F.min(place).alias("_keeper"), F.count("*").alias("_n"))
    grouped = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("root", "digest")
    )
    keepers = grouped.groupBy("component").agg(
        F.min("_keeper").alias("keeper"), F.sum("_n").alias("_n")
    ).where(F.col("_n") > 1)
    by_digest = materialize(
        grouped.select("digest", "component").join(keepers.select("component", "keeper"), "component"), "keepers"
    )
    return found.join(by_digest, "digest").where(~place.eqNullSafe(F.col("keeper"))).select(
        F.col("_id").alias(id_col), F.col("number").alias("paragraph"), "n_words",
        F.col("keeper._id").alias("keeper_id"), F.col("keeper.number").alias("keeper_paragraph"), "component",
    )
