"""Repeated passages: runs of words that also stand earlier, wherever lines begin and end.

Words are compared without case, punctuation and line breaks, so a passage inside a longer line
and one wrapped at other places are found. Windows of ``length`` words are sampled by content, as
in :mod:`flowloom.llm.repeats`: the run of ``GRAM`` words with the least identifier in a window is
its anchor, and equal windows have their anchors at equal places.

* Anchors whose run of words stands nowhere else are finished.
* Anchors with equal words in all their windows are repeats of the first of them in full.
* The first of every such part, where an anchor has several parts, is compared by its windows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.base import drop_path, release, stored, text_or_empty
from flowloom.llm.repeats import BASE, BYTE_VALUES, NO_ID, _least, _odd_power
from flowloom.llm.token_files import flat_texts
from flowloom.llm.words import IS_WORD, NEWLINE, blocks, mix
from flowloom.workspace import materialize

GRAM = 20
LOW = np.uint64(0xFFFFFFFF)


class Identifiers:
    """Identifiers of all stretches of a list of values, from one list of prefix sums."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _odd_power(BASE, len(values) + 1)[:-1], out=self.sums[1:])
        self.down = _odd_power(pow(BASE, -1, 1 << 64), len(values) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


class Words:
    """The words of some texts, with the text, number in the text and line of each. A word's
    identifier covers all of its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inner = offsets[1:-1] - offsets[0]
        stretch = np.insert(data[offsets[0] : offsets[-1]], inner, NEWLINE)
        begin = np.concatenate([[0], inner + np.arange(1, len(inner) + 1)])
        edge = np.diff(np.concatenate([[False], IS_WORD[stretch], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(starts)
        self.text = np.searchsorted(begin, starts, "right") - 1
        self.start = np.searchsorted(starts, begin)  # first word of every text
        lines = np.flatnonzero(stretch == NEWLINE)
        self.line = np.searchsorted(lines, starts) - np.searchsorted(lines, begin)[self.text]
        self.of = Identifiers(Identifiers(BYTE_VALUES[stretch]).of(starts, ends)).of

    def anchors(self, length: int):
        """(first window, last window, identifier of the anchor, identifier of all words)."""
        if self.n < length:
            return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        at = np.arange(self.n - GRAM + 1)
        grams = self.of(at, at + GRAM)
        chosen = (_least((grams & ~LOW) | at.astype(np.uint64), length - GRAM + 1) & LOW).astype(np.int64)
        text = self.text[: len(chosen)]
        valid = text == self.text[length - 1 :]
        edge = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(valid & np.concatenate([[True], edge]))
        last = np.flatnonzero(valid & np.concatenate([edge, [True]]))
        anchor = chosen[first]
        span = self.of(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(257)
        return first, last, grams[anchor], mix(span + (last - first).astype(np.uint64))


ANCHOR_SCHEMA = "gram bigint, span bigint, _id bigint, _tag bigint, place bigint, line bigint, more bigint"


def _anchors(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(2))
            for lo, hi in blocks(offsets):
                words = Words(data, offsets[lo : hi + 1])
                first, last, gram, span = words.anchors(length)
                text = words.text[first]
                rows = pa.array(text + lo)
                yield pa.record_batch(
                    [pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(rows),
                     batch.column(1).take(rows), pa.array(first - words.start[text]), pa.array(words.line[first]),
                     pa.array(last - first)],
                    names=["gram", "span", "_id", "_tag", "place", "line", "more"],
                )

    return work


def _grams_only(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _anchors(length)(batches):
            yield batch.select(["gram"])

    return work


WINDOW_SCHEMA = "key bigint, _id bigint, _tag bigint, place bigint, line bigint"


def _windows(length: int):
    """Every window of the anchors that are listed with a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(2))
            for k in range(batch.num_rows):
                words = Words(data, offsets[k : k + 2])
                place, more = (x.to_numpy() for x in batch.column(3)[k].values.flatten())
                begin = np.repeat(place - (np.cumsum(more + 1) - more - 1), more + 1) + np.arange((more + 1).sum())
                yield pa.record_batch(
                    [pa.array(words.of(begin, begin + length).view(np.int64)),
                     pa.array(np.full(len(begin), batch.column(0)[k].as_py())),
                     pa.array(np.full(len(begin), batch.column(1)[k].as_py())),
                     pa.array(begin), pa.array(words.line[begin])],
                    names=["key", "_id", "_tag", "place", "line"],
                )

    return work


GONE = ["_id", "_tag", "place", "line", "more", "keep_id", "keep_tag", "keep_place", "keep_line"]
PASSAGE_SCHEMA = (
    "_id bigint, paragraph bigint, first_word bigint, n_words bigint, "
    "keep_id bigint, keep_tag bigint, keep_place bigint, keep_line bigint"
)


def _merged(length: int):
    """Maximal runs of the words that sorted windows cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PASSAGE_SCHEMA.split(", ")]
        out, run, text = [], None, None

        def ready() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            for one, tag, place, line, more, *keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = place + more + length
                if run and text == (one, tag) and place <= run[2] + run[3]:
                    run[3] = max(run[3], end - run[2])
                else:
                    if run:
                        out.append(run)
                    run, text = [one, line, place, end - place, *keep], (one, tag)
            yield ready()
            out = []
        if run:
            out = [run]
            yield ready()

    return work


def repeated_passages(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for every maximal run of words in which each word belongs to ``length`` words that
    also stand earlier: id, ``paragraph`` (line in which it begins, from 0), ``first_word`` (its
    number in the text, from 0), ``n_words``, ``keeper_id`` and ``keeper_paragraph`` (where the
    first ``length`` of the words stand first), ``component`` (names that place).

    Earlier is by id, then by place in the text; a text's own repeats count. A null id is smaller
    than all others and a null text is empty. Different texts that share an id are taken in the
    order of their hash; rows that share id and text are one document.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    text = F.lower(text_or_empty(text_col))
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_tag"),
        text.alias("_text"),
    )
    # Written lists: joins with them shuffle both sides and can split a hot key.
    grams, grams_path = stored(
        texts.mapInArrow(_grams_only(length), "gram bigint").groupBy("gram").agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1).select("gram"),
        "passage-grams",
    )
    shared, shared_path = stored(
        texts.mapInArrow(_anchors(length), ANCHOR_SCHEMA).join(grams.hint("shuffle_hash"), "gram", "left_semi"),
        "passage-anchors",
    )
    drop_path(spark, grams_path)
    release(spark)
    where = F.struct("_id", "_tag", "place", "line")
    parts, parts_path = stored(
        shared.groupBy("gram", "span").agg(
            F.min(where).alias("keep"), F.count("*").alias("_n"), F.max("more").alias("more")),
        "passage-parts",
    )
    split, split_path = stored(
        parts.groupBy("gram").agg(F.count("*").alias("_m")).where(F.col("_m") > 1).select("gram"), "split-grams"
    )
    keeper = [F.col(f"keep.{a}").alias(b) for a, b in zip(("_id", "_tag", "place", "line"), GONE[5:], strict=True)]
    covered, covered_path = stored(
        shared.join(parts.where(F.col("_n") > 1).select("gram", "span", "keep"), ["gram", "span"])
        .where(where > F.col("keep")).select(*GONE[:5], *keeper),
        "passages-in-full",
    )
    drop_path(spark, shared_path)
    listed, listed_path = stored(
        parts.join(split, "gram", "left_semi").groupBy("keep._id", "keep._tag").agg(
            F.collect_list(F.struct(F.col("keep.place").alias("place"), "more")).alias("_places")),
        "passage-openings",
    )
    windows, windows_path = stored(
        texts.join(listed.hint("shuffle_hash"), ["_id", "_tag"]).select("_id", "_tag", "_text", "_places")
        .mapInArrow(_windows(length), WINDOW_SCHEMA),
        "passage-windows",
    )
    release(spark)
    first, first_path = stored(
        windows.groupBy("key").agg(F.min(where).alias("keep"), F.max(where).alias("_last"))
        .where(F.col("keep") != F.col("_last")).select("key", "keep"),
        "first-windows",
    )
    again = windows.join(first, "key").where(where > F.col("keep")).select(
        *GONE[:4], F.lit(0).cast("bigint").alias("more"), *keeper
    )
    merged = materialize(
        covered.unionAll(again).repartition("_id", "_tag").sortWithinPartitions(*GONE)
        .mapInArrow(_merged(length), PASSAGE_SCHEMA),
        "passages",
    )
    for path in (parts_path, split_path, covered_path, listed_path, windows_path, first_path):
        drop_path(spark, path)
    release(spark)
    real = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return merged.select(
        real("_id").alias(id_col), "paragraph", "n_words", real("keep_id").alias("keeper_id"),
        F.col("keep_line").alias("keeper_paragraph"),
        F.xxhash64("keep_id", "keep_tag", "keep_place").alias("component"), "first_word",
    )
