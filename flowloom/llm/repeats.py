"""Exact removal of repeated substrings by bucket-pointer refinement on sampled suffixes.

A byte is removed if a string of ``length`` bytes around it also starts earlier. Sorting every
suffix would cost many times the input, so suffixes are sampled in a way that depends on content
only: in every window of ``length`` bytes, the q-gram with the least bucket identifier is the
window's anchor, so equal windows have their anchors at equal places. An anchor stands for the
run of windows it was chosen by.

* Round 0 puts anchors into buckets by their q-gram. Anchors alone in a bucket are finished.
* Round 1 refines each bucket by the identifier of all that the anchor's windows span, before and
  after it. Anchors with an equal identifier in an earlier document are repeats in full; buckets
  that were not split are finished as well.
* Round 2 takes the first anchor of every part of a split bucket, with the bytes around it. A
  bucket of at most ``MANY`` such anchors is held by one task, which refines it by the
  identifiers of its single windows.
* A larger bucket is refined on Spark, by halving the offsets that the anchor may have in a window:
  all windows of one half share more bytes than the q-gram, and the identifier of what they share
  names a smaller bucket. In it, anchors with an equal identifier of the stretch that their
  windows of that half span are repeats in full; buckets that were not split are finished, small
  ones are held by a task, and the others are halved again, down to single windows. An anchor
  gives two rows a halving at most, and only while its bucket is both large and split.

A bucket identifier is a 64-bit polynomial of the bytes; identifiers of any stretch come from
the same prefix sums, so those of later rounds reuse what earlier rounds computed, and a pair of
(bucket, stretch) identifiers names a part from round 1 on. Buckets are reduced to their least
document by combining aggregates.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.base import drop_path, release, stored, text_or_empty
from flowloom.llm.token_files import flat_texts
from flowloom.workspace import materialize

GRAM = 32
BLOCK = 1 << 20  # bytes hashed at a time; positions in a block fit in POSITION bits
POSITION = np.uint64(BLOCK - 1)
BACK_BITS = 7
MANY = 2_000  # openings of a bucket from which it is halved instead of held
HELD = 20_000  # spans resolved at a time


def _odd_power(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(4).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
UP = _odd_power(BASE, BLOCK + 1)
DOWN = _odd_power(pow(BASE, -1, 1 << 64), BLOCK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Identifiers:
    """Bucket identifiers of all stretches of one block."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * UP[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * DOWN[begin])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:-width]) * DOWN[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Anchors of the windows of texts [start, end) in one block: (text, first window, last
    window, anchor, q-gram identifier, identifier of the span). Windows lie in one text."""
    ids = Identifiers(data)
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    grams = ids.grams(GRAM)
    ranked = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_least(ranked, length - GRAM + 1) & POSITION).astype(np.int64)
    lasting = ends - starts >= length
    starts, ends, number = starts[lasting], ends[lasting], np.flatnonzero(lasting)
    edge = np.zeros(len(data) + 2, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends - length + 1, -1)
    valid = edge.cumsum()[: len(chosen)] > 0
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = chosen[1:] != chosen[:-1]
    fresh[starts] = True
    fresh |= np.concatenate([[False], ~valid[:-1]])
    fresh &= valid
    first = np.flatnonzero(fresh)
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    anchor = chosen[first]
    text = number[np.searchsorted(starts, first, "right") - 1]
    span = ids.of(first, stop + length)
    span = _mix(span + (anchor - first).astype(np.uint64) * np.uint64(257) + (stop - first).astype(np.uint64))
    return text, first, stop, anchor, grams[anchor], span


def _blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first text, end text, begin, end, begin of the first text): whole texts up to a block
    together, longer texts in pieces that overlap so that each window lies in one piece."""
    k, n = 0, len(offsets) - 1
    while k < n:
        upto = int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1
        if upto > k:
            yield k, upto, int(offsets[k]), int(offsets[upto]), int(offsets[k])
            k = upto
            continue
        for at in range(int(offsets[k]), int(offsets[k + 1]) - length + 1, BLOCK - length + 1):
            yield k, k + 1, at, min(at + BLOCK, int(offsets[k + 1])), int(offsets[k])
        k += 1


def _repeated_before(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows whose key has an earlier place."""
    order = np.lexsort((place, keys))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


# Where an anchor's windows lie: place of the first window, number of windows less one, and
# whether the text has them earlier. Rows that share an id are told apart by a 64-bit tag.
def _pack(place, more, again) -> np.ndarray:
    return (place << BACK_BITS | more) << 1 | again


def _unpack(packed: np.ndarray):
    return packed >> 1 + BACK_BITS, packed >> 1 & ((1 << BACK_BITS) - 1), packed & 1


ANCHOR_SCHEMA = "gram bigint, span bigint, _id bigint, _tag bigint, place bigint"


def _sample(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Pieces of a long text are held together to tell what it repeats itself.
            held, held_of = [], -1
            for k, end, lo, hi, origin in _blocks(offsets, length):
                cut = np.clip(offsets[k : end + 1], lo, hi) - lo
                text, first, last, _, gram, span = anchors(data[lo:hi], cut[:-1], cut[1:], length)
                place = first + lo - (offsets[k + text] if end - k > 1 else origin)
                found = (text + k, place, last - first, gram, span)
                if held and held_of != k:
                    yield _anchor_rows(held, ids, tags)
                    held = []
                held, held_of = [*held, found], k
            if held:
                yield _anchor_rows(held, ids, tags)

    return work


def _anchor_rows(held: list, ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    text, place, more, gram, span = (np.concatenate(x) for x in zip(*held, strict=True))
    both = _mix(gram) + span + _mix(text.astype(np.uint64) + np.uint64(1))
    again = _repeated_before(both, place)
    packed = _pack(place, more, again)
    return pa.record_batch(
        [pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[text]), pa.array(tags[text]),
         pa.array(packed)],
        names=["gram", "span", "_id", "_tag", "place"],
    )


def _grams_only(length: int):
    sample = _sample(length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sample(batches):
            yield batch.select(["gram"])

    return work


SPAN_SCHEMA = "gram bigint, _id bigint, _tag bigint, place bigint, many boolean, bytes binary"
HALF_SCHEMA = "gram bigint, part bigint, _id bigint, _tag bigint, place bigint, bytes binary, anchor int, low int, high int"


def _spans(length: int):
    """The bytes that the windows of each listed anchor span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"gram": [], "_id": [], "_tag": [], "place": [], "many": [], "bytes": []}
            for one, tag, text, listed in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, fields = memoryview(text.as_buffer() or b""), listed.values.flatten()
                first, more, _ = _unpack(fields[0].to_numpy())
                ends = (first + more + length).tolist()
                rows["gram"] += fields[1].to_pylist()
                rows["_id"] += [one.as_py()] * len(ends)
                rows["_tag"] += [tag.as_py()] * len(ends)
                rows["place"] += fields[0].to_pylist()
                rows["many"] += fields[2].to_pylist()
                rows["bytes"] += [bytes(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch(
                [pa.array(column, kind) for column, kind in zip(rows.values(), kinds, strict=True)],
                names=list(rows),
            )

    return work


def _window_ids(batch: pa.RecordBatch, length: int):
    """(row, place of the window, identifier) of every window of a table of spans."""
    first, more, _ = _unpack(batch["place"].to_numpy())
    column = batch["bytes"].cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    rows, places, keys = [], [], []
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        count = more[at:end] + 1
        row = np.repeat(np.arange(at, end), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[row] - offsets[at] + step
        rows.append(row)
        places.append(first[row] + step)
        keys.append(Identifiers(data[offsets[at] : offsets[end]]).of(begin, begin + length))
        at = end
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.concatenate(rows)
    gram = batch["gram"].to_numpy().view(np.uint64)
    return row, np.concatenate(places), _mix(np.concatenate(keys) + _mix(gram[row]))


def _repeats_in_buckets(length: int):
    """From spans sorted by q-gram, the windows that start earlier elsewhere. Buckets are small;
    rows are held until their bucket ends."""

    def resolve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks()
        row, place, key = _window_ids(batch, length)
        one, tag = batch["_id"].to_numpy()[row], batch["_tag"].to_numpy()[row]
        order = np.lexsort((place, tag, one, key))
        same = key[order[1:]] == key[order[:-1]]
        start = np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, np.arange(len(order))))
        later = one[order] > one[order[start]]
        later[1:] |= same & (one[order[1:]] == one[order[:-1]]) & (tag[order[1:]] == tag[order[:-1]])
        gone = np.sort(order[later])
        fresh = np.ones(len(gone), bool)
        fresh[1:] = (np.diff(place[gone]) != 1) | (np.diff(row[gone]) != 0)
        first = np.flatnonzero(fresh)
        more = np.diff(np.append(first, len(gone))) - 1
        packed = _pack(place[gone[first]], more, 0)
        return pa.record_batch(
            [pa.array(one[gone[first]]), pa.array(tag[gone[first]]), pa.array(packed)], names=["_id", "_tag", "place"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            gram = batch.column(0).to_numpy()
            cut = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            if count >= HELD and len(cut):
                held[-1] = batch.slice(0, int(cut[-1]))
                yield resolve(held)
                held = [batch.slice(int(cut[-1]))]
                count = held[0].num_rows
        if count:
            yield resolve(held)

    return work


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _placed_anchors(length: int):
    """Rows of large buckets with the place of the anchor in their bytes, the first at which the
    q-gram stands, and all offsets that an anchor may have in a window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _flat(batch.column(4))
            anchor = np.zeros(batch.num_rows, np.int32)
            if batch.num_rows:
                gram = Identifiers(data).grams(GRAM)
                row = np.searchsorted(offsets, np.arange(len(gram)), "right") - 1
                at = np.flatnonzero(gram == batch.column(0).to_numpy().view(np.uint64)[row])
                at = at[at + GRAM <= offsets[row[at] + 1]]
                first = np.append(True, row[at][1:] != row[at][:-1])
                anchor[row[at[first]]] = at[first] - offsets[row[at[first]]]
            rows = np.zeros(batch.num_rows, np.int32)
            yield pa.record_batch(
                [batch.column(0), batch.column(0), *(batch.column(k) for k in range(1, 5)), pa.array(anchor), pa.array(rows),
                 pa.array(rows + (length - GRAM))],
                names=[f.split()[0] for f in HALF_SCHEMA.split(", ")],
            )

    return work


def _halved(length: int):
    """Each row once or twice: its windows with the anchor at the lower and at the upper half of the
    offsets, if there are any, by the identifier of what all windows of that half share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK // 256):
                yield halves(batch.slice(first, BLOCK // 256))

    def halves(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _flat(batch["bytes"])
        ids, text = Identifiers(data), data.tobytes()
        place, more, _ = _unpack(batch["place"].to_numpy())
        anchor, low, high = (batch[c].to_numpy().astype(np.int64) for c in ("anchor", "low", "high"))
        middle = (low + high) // 2
        parts = []
        for a, b in ((low, middle), (middle + 1, high)):
            # Windows begin at anchor - offset; the row has those of the offsets anchor - more .. anchor.
            least, most = np.maximum(a, anchor - more), np.minimum(b, anchor)
            row = np.flatnonzero(least <= most)
            a, b, least, most = a[row], b[row], least[row], most[row]
            base = offsets[row] + anchor[row]
            shared = _mix(ids.of(base - b + (b - a), base - b + length) + _mix((a * 256 + b).astype(np.uint64)))
            begin, end = base - most, base - least + length
            span = _mix(ids.of(begin, end) + (most * 256 + least).astype(np.uint64) * np.uint64(257))
            key = _mix(shared + _mix(batch["gram"].to_numpy().view(np.uint64)[row]))
            parts.append((row, key, span, place[row] + (anchor[row] - most), most - least, begin, end, most, a, b))
        row, key, span, place, more, begin, end, most, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.record_batch(
            [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), batch["_id"].take(pa.array(row)), batch["_tag"].take(pa.array(row)),
             pa.array(_pack(place, more, 0)), pa.array([text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
             *(pa.array(x.astype(np.int32)) for x in (most, a, b))],
            names=[f.split()[0] for f in HALF_SCHEMA.split(", ")],
        )

    return work


def _refine(crowded: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One halving of large buckets: (repeats, rows of small buckets that are still split, rows of
    large ones)."""
    halves = materialize(crowded.mapInArrow(_halved(length), HALF_SCHEMA), "halved-buckets")
    part = ["gram", "part"]
    parts = materialize(halves.groupBy(*part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "half-parts")
    several = parts.where(F.col("_n") > 1)
    own = materialize(
        halves.join(several, part, "left_semi").groupBy(*part, "_id", "_tag").agg(F.min("place").alias("_place"), F.count("*").alias("_own"))
        .where(F.col("_own") > 1).drop("_own"),
        "half-own",
    )
    judged = halves.join(parts, part).join(own, [*part, "_id", "_tag"], "left")
    later = (F.col("_id") > F.col("_first")) | F.coalesce(F.col("place") > F.col("_place"), F.lit(False))
    judged = materialize(judged.withColumn("_later", later).drop("_first", "_n", "_place"), "judged-halves")
    split = parts.groupBy("gram").agg(F.count("*").alias("_m")).where(F.col("_m") > 1).select("gram")
    openings = materialize(judged.where(~F.col("_later")).drop("_later").join(split, "gram", "left_semi"), "half-openings")
    sizes = materialize(
        openings.groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") > MANY).select("gram"), "crowded-halves"
    )
    again = judged.where("_later").select("_id", "_tag", "place")
    return again, openings.join(sizes, "gram", "left_anti"), openings.join(sizes, "gram", "left_semi")


def _cut(length: int):
    """What is left of a text without the stretches that its list covers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                cover = np.zeros(len(data) + 1, np.int32)
                if places.is_valid:
                    first, more, _ = _unpack(places.values.to_numpy())
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + more + length, -1)
                gone = cover.cumsum()[:-1] > 0
                rows["n_bytes"].append(len(data))
                rows["n_removed"].append(int(gone.sum()))
                rows["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept = data[~gone] if gone.any() else data
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column(0), *map(pa.array, rows.values())], names=["_id", *rows])

    return work


NO_ID = -(1 << 63)  # a null id while documents are compared


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept_sha256`` (of the bytes that stay), after removing every byte covered by a
    string of ``length`` bytes (at least 64, at most 150) that also starts in a document of
    smaller id, or earlier in the same document.

    Texts are UTF-8 bytes; a null text is empty. Texts under ``length`` bytes lose nothing. Null
    ids count as smaller than all others. Rows that share an id are not earlier than each other:
    each is judged against smaller ids and itself. An empty table gives an empty result.
    """
    if not 64 <= length <= 150:
        raise ValueError("length must be from 64 to 150")
    text = text_or_empty(text_col)
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_tag"), text.alias("_text"),
    )
    own = F.col("place").bitwiseAND(1) == 1

    # Round 0: q-gram buckets with more than one anchor.
    # A written list: the join with it then shuffles both sides itself and can split a hot q-gram.
    grams, grams_path = stored(
        texts.mapInArrow(_grams_only(length), "gram bigint").groupBy("gram").agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1).select("gram"),
        "shared-grams",
    )
    release(docs.sparkSession)
    sampled = texts.mapInArrow(_sample(length), ANCHOR_SCHEMA)
    shared, shared_path = stored(sampled.join(grams.hint("shuffle_hash"), "gram", "left_semi"), "shared-anchors")
    release(docs.sparkSession)

    # Round 1: refined by the span around the anchor.
    parts, parts_path = stored(
        shared.groupBy("gram", "span").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")),
        "bucket-parts",
    )
    split = parts.groupBy("gram").agg(F.count("*").alias("_m")).where(F.col("_m") > 1).select("gram")
    several = parts.where(F.col("_n") > 1)
    covered = materialize(
        shared.join(several, ["gram", "span"]).where(own | (F.col("_id") > F.col("_first")))
        .select("_id", "_tag", "place"),
        "covered-anchors",
    )
    release(docs.sparkSession)
    # The first anchors of the parts of split buckets, with the bytes around them.
    openings = materialize(
        shared.where(~own).join(parts.join(split, "gram"), ["gram", "span"])
        .where(F.col("_id") == F.col("_first")).select("_id", "_tag", "place", "gram"),
        "openings",
    )
    # Counted in openings: texts that share the least id all open a part.
    crowded = materialize(
        openings.groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") > MANY)
        .select("gram", F.lit(True).alias("_many")),
        "crowded-buckets",
    )
    openings = openings.join(crowded, "gram", "left").withColumn("many", F.coalesce("_many", F.lit(False)))
    for path in (grams_path, shared_path, parts_path):
        drop_path(docs.sparkSession, path)
    release(docs.sparkSession)
    listed = openings.groupBy("_id", "_tag").agg(F.collect_list(F.struct("place", "gram", "many")).alias("_places"))
    spans = materialize(
        texts.join(listed.hint("shuffle_hash"), ["_id", "_tag"]).select("_id", "_tag", "_text", "_places")
        .mapInArrow(_spans(length), SPAN_SCHEMA),
        "spans",
    )
    release(docs.sparkSession)

    # Round 2: large buckets are halved until their parts are small, agree or differ.
    held, again = spans.where(~F.col("many")).drop("many"), covered
    rest = materialize(
        spans.where("many").select("gram", "_id", "_tag", "place", "bytes").mapInArrow(_placed_anchors(length), HALF_SCHEMA),
        "crowded-spans",
    )
    while rest.limit(1).count():
        repeated, small, rest = _refine(rest, length)
        again, held = again.unionAll(repeated), held.unionAll(small.select(held.columns))
        rest = materialize(rest, "crowded-spans")
    narrow = (
        held.repartition("gram").sortWithinPartitions("gram", "_id", "place")
        .mapInArrow(_repeats_in_buckets(length), "_id bigint, _tag bigint, place bigint")
    )
    again = again.unionAll(narrow)
    gone = again.groupBy("_id", "_tag").agg(
        F.collect_list("place").alias("_gone")
    )
    cut = texts.join(gone.hint("shuffle_hash"), ["_id", "_tag"], "left").select("_id", "_text", "_gone")
    result = cut.mapInArrow(
        _cut(length), "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return result.select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col),
        "n_bytes", "n_removed", "n_spans", "kept_sha256",
    )
