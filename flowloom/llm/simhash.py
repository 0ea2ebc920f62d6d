"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made in one pass over the texts. Distinct fingerprints are cut into ``blocks``
bit blocks; two that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of
them, so buckets on every choice of that many blocks hold all links. Inside buckets, fingerprints
stand vertically, one bit plane for each bit: a word of a plane holds that bit of 64 neighbours,
and one pass over the planes counts the distances of 64 pairs at a time in carry-save counters.
Blocks of pairs whose counters have all passed the radius are abandoned.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.base import byte_views
from flowloom.llm.components import components
from flowloom.workspace import materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLAB = 100_000  # rows of whole buckets compared at a time
CROWDED = 8_192  # buckets above this are cut once more
STEP = 16  # plane rows between looks at what can be abandoned


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-width] + 1]).tolist()
    end = end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(end), 1 << 16):
        part = zip(begin[at : at + (1 << 16)], end[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(end)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(id, fingerprint as a signed 64-bit integer)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(bytes(x), width, seed) for x in byte_views(batch.column(1))]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(signed)], names=["_id", "_fp"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(work, "_id bigint, _fp bigint")


def _bits(low: int, high: int) -> Column:
    """Bits [low, high) of the fingerprint."""
    return F.shiftrightunsigned("_fp", low).bitwiseAND((1 << (high - low)) - 1)


def _ranges(blocks: int) -> list[tuple[int, int]]:
    ends = [round(64 * k / blocks) for k in range(blocks + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _bucketed(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(key, _fp): each fingerprint under every choice of blocks. A crowded bucket is cut by
    the value of one of ``radius + 1`` blocks, one of which must agree as well."""
    keys = []
    for number, chosen in enumerate(combinations(_ranges(blocks), blocks - radius)):
        key = F.lit(number).cast("bigint")
        for low, high in chosen:
            key = F.shiftleft(key, high - low).bitwiseOR(_bits(low, high))
        keys.append(key)
    rows = prints.select("_fp", F.explode(F.array(*keys)).alias("key"))
    crowded = rows.groupBy("key").count().where(F.col("count") > CROWDED).select(
        "key", F.lit(True).alias("_crowded")
    )
    finer = [
        F.struct(F.lit(k).alias("part"), _bits(low, high).alias("value"))
        for k, (low, high) in enumerate(_ranges(radius + 1))
    ]
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("value")))
    return rows.join(crowded, "key", "left").select(
        "_fp", "key", F.explode(F.when(F.col("_crowded"), F.array(*finer)).otherwise(whole)).alias("_sub")
    ).select("key", "_sub.part", "_sub.value", "_fp")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words; bit ``i % 64`` of word ``i // 64`` of a row is that bit of value i."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    packed = np.packbits(bits, axis=1, bitorder="little")
    words = -(-len(values) // 64)
    full = np.zeros((64, (words + 1) * 8), np.uint8)
    full[:, : packed.shape[1]] = packed
    return full.view("<u8")


def close_pairs(planes: np.ndarray, words: np.ndarray, shifts: np.ndarray, lanes: np.ndarray,
                radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, i + shift) within ``radius`` bits, among the lanes given for each (word, shift).
    Counters start at such a value that passing the radius overflows them."""
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(len(words), ones * np.uint64(start >> k & 1), np.uint64) for k in range(depth)]
    alive = lanes.copy()
    last = planes.shape[1] - 1
    for at in range(0, 64, STEP):
        whole, part = np.divmod(shifts, 64)
        near, far = np.minimum(words + whole, last), np.minimum(words + whole + 1, last)
        right, left = part.astype(np.uint64), (64 - part).astype(np.uint64)
        for plane in planes[at : at + STEP]:
            carry = plane[words] ^ (plane[near] >> right | plane[far] << left)
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry
        keep = alive != 0
        words, shifts, alive = words[keep], shifts[keep], alive[keep]
        counters = [x[keep] for x in counters]
        if not len(words):
            break
    block, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    first = words[block] * 64 + lane
    return first, first + shifts[block]


class Forest:
    """Disjoint sets over 0..n-1, with the least member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.settle()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within every run of equal keys, the values connected by distances up to
    ``radius``: one link for each value that is not the first of its set."""
    forest = Forest(len(keys))
    rows, reach = np.arange(len(keys)), 1
    while True:
        run = np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]]).cumsum() - 1
        root = forest.settle()[rows]
        size = np.bincount(run)
        first = root[np.concatenate([[0], np.cumsum(size)[:-1]])] if len(rows) else root
        split = np.bincount(run, root != first[run]) > 0
        go_on = ((size > reach) & split)[run]
        rows = rows[go_on]
        if not len(rows):
            break
        own = keys[rows]
        planes = bit_planes(values[rows])
        longest = int(np.bincount(run[go_on]).max())
        for shift in range(reach, min(2 * reach, longest), STEP):
            words, shifts, lanes = [], [], []
            for d in range(shift, min(shift + STEP, 2 * reach, longest)):
                same = np.packbits(own[:-d] == own[d:], bitorder="little")
                same = np.concatenate([same, np.zeros(-len(same) % 8, np.uint8)]).view("<u8")
                used = np.flatnonzero(same)
                words.append(used)
                lanes.append(same[used])
                shifts.append(np.full(len(used), d))
            a, b = close_pairs(planes, np.concatenate(words), np.concatenate(shifts),
                               np.concatenate(lanes), radius)
            forest.link(rows[a], rows[b])
        reach *= 2
    root = forest.settle()
    linked = np.flatnonzero(root != np.arange(len(keys)))
    return linked, root[linked]


def _compare(radius: int):
    """Partitions sorted by bucket are compared slab by slab; a slab ends with a bucket."""

    def slab(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ends = np.zeros(rows.num_rows, bool)
        for name in ("key", "part", "value"):
            column = rows[name].to_numpy()
            ends[1:] |= column[1:] != column[:-1]
        prints = rows["_fp"].to_numpy()
        a, b = bucket_links(ends.cumsum(), prints.view(np.uint64), radius)
        return pa.record_batch([pa.array(prints[a]), pa.array(prints[b])], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < SLAB:
                continue
            keys = [batch[name].to_numpy() for name in ("key", "part", "value")]
            new = np.zeros(batch.num_rows, bool)
            for column in keys:
                new[1:] |= column[1:] != column[:-1]
            cut = np.flatnonzero(new)
            if len(cut):
                held[-1] = batch.slice(0, int(cut[-1]))
                yield slab(held)
                held = [batch.slice(int(cut[-1]))]
                count = held[0].num_rows
        if held:
            yield slab(held)

    return work


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4,
    blocks: int = 6, width: int = 4, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id that chains of links of at most ``radius`` bits reach).

    A null text is the empty text; texts without words have fingerprint zero and are linked like
    any other. Rows with a null id are fingerprinted and can carry a chain; a component of such
    rows alone has a null component. An empty table gives an empty result. More ``blocks`` make
    finer buckets, for more rows each, and never change the result.
    """
    named = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    prints = named.groupBy("_fp").agg(F.min("_id").alias("_least"))
    pairs = (
        _bucketed(prints.select("_fp"), radius, blocks)
        .repartition("key", "part", "value").sortWithinPartitions("key", "part", "value", "_fp")
        .mapInArrow(_compare(radius), "u bigint, v bigint")
    )
    roots = components(pairs).withColumnRenamed("node", "_fp")
    placed = prints.join(roots, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_print = placed.join(least, "root").select("_fp", "component_id")
    return named.join(by_print, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
