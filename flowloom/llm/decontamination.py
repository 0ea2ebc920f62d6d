"""Benchmark decontamination by greedy string tiling.

Test items are taken in blocks of bounded size, and every block is sent to the executors once.
In a pass over the texts, runs of ``least`` words that an item also has are the seeds; texts and
items that share seeds enough for the threshold are tiled: longest common stretches that do not
overlap are marked one after the other, found by running Karp-Rabin hashes of falling length.
The share of an item's words that tiles cover does not depend on their order, so passages that
were cut up and reordered are found as well. Texts are never shuffled.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowloom.llm.base import text_or_empty
from flowloom.llm.token_files import flat_texts
from flowloom.llm.words import RunningHash, runs, text_words, word_ids

BLOCK_BYTES = 8 << 20  # of items' texts that are sent to the executors at a time
BITS = 20
PAIRS = 1 << 20  # pairs of places in a text and an item that are held together


def _stretches(marked: np.ndarray, width: int) -> np.ndarray:
    """Whether each run of ``width`` places is free of marks."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[width:] == total[: len(total) - width]


def _common(text: RunningHash, item: RunningHash, text_free: np.ndarray, item_free: np.ndarray, size: int):
    """Longest extensions (length, place in text, place in item) of all unmarked stretches of
    ``size`` words that text and item share, in arrays. Pairs of places are made for a part of the
    text at a time, ``PAIRS`` together or those of one place, and stretches that reach the end of a
    part go on in the next."""
    a, b = text.runs(size), item.runs(size)
    a_at = np.flatnonzero(_stretches(~text_free, size)[: len(a)])
    b_at = np.flatnonzero(_stretches(~item_free, size)[: len(b)])
    order = np.argsort(b[b_at], kind="stable")
    b_at = b_at[order]
    low, high = np.searchsorted(b[b_at], a[a_at], "left"), np.searchsorted(b[b_at], a[a_at], "right")
    met = np.flatnonzero(high > low)
    a_at, low, count = a_at[met], low[met], (high - low)[met]
    upto = np.cumsum(count)
    found, nothing = [], np.zeros(0, np.int64)
    open_diagonal, open_i, open_n = nothing, nothing, nothing
    at = 0
    while at < len(a_at):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        part = count[at:end]
        i = np.repeat(a_at[at:end], part)
        j = b_at[np.repeat(low[at:end] - (np.cumsum(part) - part), part) + np.arange(part.sum())]
        order = np.lexsort((i, i - j))
        i, diagonal = i[order], (i - j)[order]
        # Neighbours on one diagonal are one stretch.
        first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(diagonal) != 0)]))
        n = np.diff(np.append(first, len(i)))
        i, diagonal = i[first], diagonal[first]
        if len(open_i):
            place = np.minimum(np.searchsorted(diagonal, open_diagonal), len(diagonal) - 1)
            goes_on = (diagonal[place] == open_diagonal) & (i[place] == open_i + open_n)
            i[place[goes_on]] = open_i[goes_on]
            n[place[goes_on]] += open_n[goes_on]
            found.append((open_n[~goes_on], open_i[~goes_on], (open_i - open_diagonal)[~goes_on]))
        still = i + n - 1 == a_at[end - 1]
        open_diagonal, open_i, open_n = diagonal[still], i[still], n[still]
        found.append((n[~still], i[~still], (i - diagonal)[~still]))
        at = end
    found.append((open_n, open_i, open_i - open_diagonal))
    n, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return n + size - 1, i, j


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in text, place in item) of at least ``least`` words: always the
    longest stretch that no tile overlaps, ties to the earlier place in text, then item."""
    text_free, item_free = np.ones(len(text), bool), np.ones(len(item), bool)
    hashes = RunningHash(text), RunningHash(item)
    tiles = []
    size = max(least, min(len(text), len(item)) // 2)
    while min(len(text), len(item)) >= least and item_free.sum() >= least:
        length, i_at, j_at = _common(*hashes, text_free, item_free, size)
        order = np.lexsort((j_at, i_at, -length))
        queue: list[tuple[int, int, int]] = []  # what is left of stretches that a tile overlaps
        at = 0
        while (queue or at < len(order)) and item_free.any():
            head = (-int(length[order[at]]), int(i_at[order[at]]), int(j_at[order[at]])) if at < len(order) else None
            if head is None or (queue and queue[0] < head):
                n, i, j = heapq.heappop(queue)
            else:
                n, i, j = head
                at += 1
            free = text_free[i : i - n] & item_free[j : j - n]
            if free.all():
                tiles.append((-n, i, j))
                text_free[i : i - n] = item_free[j : j - n] = False
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in edge.reshape(-1, 2).tolist():
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, j + a))
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


class Items:
    """One block of test items with the seeds they have."""

    def __init__(self, rows: list[tuple[int, str]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        words = [word_ids(np.frombuffer(text.encode(), np.uint8))[1] for _, text in rows]
        kept = [k for k, w in enumerate(words) if len(w) >= least]
        self.names = [rows[k][0] for k in kept]
        self.words = [words[k] for k in kept]
        seeds = [runs(w, least) for w in self.words]
        seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds] or [np.zeros(0, np.int64)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[(self.seed >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, share of the item's words in tiles, tiles, longest tile)."""
        for _, text, ids in text_words(data, offsets):
            grams = runs(ids, self.least)
            at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
            at = at[text[at] == text[at + self.least - 1]]
            # Each seed of a text once, however often the text repeats it.
            at = at[np.unique(np.stack([text[at].astype(np.uint64), grams[at]]), axis=1, return_index=True)[1]]
            low = np.searchsorted(self.seed, grams[at], "left")
            count = np.searchsorted(self.seed, grams[at], "right") - low
            if not count.sum():
                continue
            hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            # Distinct (text, item, place of a seed in the item).
            cell = np.unique(np.stack([np.repeat(text[at], count), self.item[hit], self.place[hit]]), axis=1)
            fresh = np.concatenate([[True], (np.diff(cell[:2]) != 0).any(axis=0)])
            bounds = np.append(np.flatnonzero(fresh), cell.shape[1])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                t, e = int(cell[0, a]), int(cell[1, a])
                item = self.words[e]
                cover = np.zeros(len(item) + 1, np.int64)
                np.add.at(cover, cell[2, a:b], 1)
                np.add.at(cover, np.minimum(cell[2, a:b] + self.least, len(item)), -1)
                if (cover.cumsum()[:-1] > 0).sum() < self.threshold * len(item):
                    continue  # not even all seeds together cover enough
                lo, hi = np.searchsorted(text, [t, t + 1])
                tiles = tile(ids[lo:hi], item, self.least)
                covered = sum(n for n, _, _ in tiles)
                if covered >= self.threshold * len(item):
                    yield t, e, covered / len(item), len(tiles), max(n for n, _, _ in tiles)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size. Every block is sent to the executors and stays in the plan of
    its pass over the texts: the whole benchmark must fit in the driver's memory."""
    held, size = [], 0
    texts = benchmark.select(F.col(item_col).cast("bigint"), F.lower(text_or_empty(text_col)))
    for name, text in texts.toLocalIterator():
        held.append((name, text))
        size += len(text.encode())
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", least: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """One row for every text and item whose tiles of at least ``least`` words cover
    ``threshold`` of the item: id, item id, ``coverage``, ``n_tiles``, ``longest_tile``.

    Null texts are empty and match nothing; items under ``least`` words are too short to match.
    Rows with null or repeated ids are compared like any other. Without items or texts the
    result is empty.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.lower(text_or_empty(text_col)).alias("_text"))
    schema = f"`{id_col}` bigint, `{item_col}` bigint, coverage double, n_tiles int, longest_tile int"
    names = [id_col, item_col, "coverage", "n_tiles", "longest_tile"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    found = docs.sparkSession.createDataFrame([], schema)
    for rows in item_blocks(benchmark, item_col, item_text):
        items = Items(rows, least, threshold)

        def work(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = [(ids[t], items.names[e], *rest) for t, e, *rest in items.matches(*flat_texts(batch.column(1)))]
                columns = list(zip(*hits, strict=True)) or [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = found.unionAll(texts.mapInArrow(work, schema))
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", least: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text no item matches."""
    for rows in item_blocks(benchmark, item_col, item_text):
        items = Items(rows, least, threshold)

        def work(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in items.matches(*flat_texts(batch.column(1)))]] = False
                yield batch.select([0]).filter(pa.array(clean))

        packed = docs.select(F.struct("*").alias("_row"), F.lower(text_or_empty(text_col)).alias("_text"))
        docs = packed.mapInArrow(work, T.StructType([packed.schema["_row"]])).select("_row.*")
    return docs
