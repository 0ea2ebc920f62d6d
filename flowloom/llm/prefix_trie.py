"""Trie of conversation prefixes by truncation peeling.

A conversation is reduced to its path: one record of 20 bytes a turn, a digest of role and text
and the number of words. Conversations with equal paths are one row. Rows are sorted by path
across range partitions, so that a node's members are neighbours. Every task peels its
partition: from the greatest depth down it merges the conversations that end at a depth with the
nodes that survive from below, strips the last record and regroups. Nodes, their counts and
their subtree sums come out of that one pass.

Only the prefixes of the first and of the last path of a partition can have members in other
partitions. These open nodes, at most two a level and partition, are merged afterwards. No group
is held by one task: a turn that a third of all conversations begin with is an open node in many
partitions.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.base import text_or_empty
from flowloom.workspace import checked_broadcast, materialize

RECORD = 20  # bytes of a turn in a path: 16 of the digest, 4 of the number of words
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 10_000  # conversation ids listed together

NODE_SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, open boolean, path binary, parent binary, words bigint"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_record() -> Column:
    """Hexadecimal record of a turn with columns ``role`` and ``text``."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(WORD)))), 8, "0"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation of ``turns``: conv_id, turn, role, text. Turns are
    ordered by ``turn``, null first; those that tie, by their record. Rows without a conv_id
    belong to no conversation."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_record().alias("record")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "record")))["record"]
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("path"))


def branched(own: DataFrame, every: int = 20, turns: int = 4) -> DataFrame:
    """Conversations that begin as the first of each ``every`` ids does: of conversation ``c``,
    the first crc32(c) % ``turns`` turns are those of ``c - c % every`` (all if it has fewer, none
    if there is none), and its own later turns follow."""
    taken = (F.crc32(F.col("conv_id").cast("string")) % turns * RECORD).cast("int")
    base = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.substring("path", 1, (turns - 1) * RECORD).alias("_head")
    )
    met = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(base, "_base", "left")
    head = F.coalesce(F.substr(F.col("_head"), F.lit(1), taken), F.lit(b""))
    return met.select("conv_id", F.concat(head, F.substr(F.col("path"), taken + 1)).alias("path"))


def _shared(path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted paths: depth, records shared with the path before (-1 for the first), place of
    the first record, and the number of words of every record."""
    column = path.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, RECORD)
    begin = (offsets[:-1] - offsets[0]) // RECORD
    depth = np.diff(offsets) // RECORD
    both = np.minimum(depth[1:], depth[:-1])
    row = np.repeat(np.arange(len(both)), both)
    step = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    differ = (data[begin[row] + step] != data[begin[row + 1] + step]).any(axis=1)
    shared = both.copy()
    np.minimum.at(shared, row[differ], step[differ])
    return depth, np.append(-1, shared), begin, data[:, 16:].copy().view(">u4").ravel().astype(np.int64)


def peel(path: pa.Array, n: np.ndarray, least: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition, level by level from the deepest. ``path``: its distinct paths in
    order, with the number of conversations, the least id and the digest of the ids of each.

    The sums of open nodes leave out what open nodes below them add. Open nodes carry their
    path, and nodes below an open one carry its path as ``parent``."""
    if not len(path):
        return
    depth, shared, begin, words = _shared(path)
    deepest = int(depth.max())
    by_depth = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[by_depth], np.arange(deepest + 2))
    # What survives from the level below: first member, members, least id, and what each node
    # adds to its parent's children, leaves and saved words.
    first, count, low, children, leaves, saved = (np.zeros(0, np.int64),) * 6
    below: dict[str, pa.Array] = {}
    for d in range(deepest, -1, -1):
        ended = by_depth[level[d] : level[d + 1]]
        member = np.concatenate([ended, first])
        order = np.argsort(member, kind="stable")
        fresh = shared[member[order]] < d
        start = np.flatnonzero(fresh)
        group = np.empty(len(member), np.int64)
        group[order] = np.cumsum(fresh) - 1

        def regroup(of_ended: np.ndarray, of_survivors: np.ndarray, ufunc=np.add) -> np.ndarray:
            return ufunc.reduceat(np.concatenate([of_ended, of_survivors])[order], start)  # noqa: B023

        none, parent = np.zeros(len(ended), np.int64), group[len(ended) :]
        count, low = regroup(n[ended], count), regroup(least[ended], low, np.minimum)
        children, leaves, saved = regroup(none, children), regroup(none, leaves), regroup(none, saved)
        first = member[order][start]
        is_open = first == 0
        is_open[-1] |= depth[-1] >= d
        prefix = {int(k): path[int(first[k])].as_py()[: d * RECORD] for k in np.flatnonzero(is_open)}
        if below:
            yield _rows(below, parent_conv_id=pa.array(low[parent]), parent=_where_open(prefix, parent))
        word = words[begin[first] + d - 1] if d else np.zeros(len(first), np.int64)
        own = np.full(len(first), NO_ENDS, object)
        own[group[: len(ended)]] = ends[ended]
        leaves = np.where(is_open, leaves, leaves + (children == 0))
        saved = np.where(is_open, saved, saved + (count - 1) * word)
        below = {
            "conv_id": low, "depth": np.full(len(first), d), "n_convs": count, "n_children": children, "n_leaves": leaves,
            "saved_tokens": saved, "ends_sha256": own, "open": is_open, "path": _where_open(prefix, np.arange(len(first))),
            "words": word,
        }
        children, leaves, saved = (np.where(is_open, 0, x) for x in (np.ones(len(first), np.int64), leaves, saved))
    yield _rows(below, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()))


NAMES = [field.split()[0] for field in NODE_SCHEMA.split(", ")]


def _rows(level: dict, parent_conv_id: pa.Array, parent: pa.Array) -> pa.RecordBatch:
    columns = level | {"parent_conv_id": parent_conv_id, "parent": parent}
    return pa.record_batch([pa.array(columns[name]) for name in NAMES], names=NAMES)


def _where_open(prefix: dict[int, bytes], node: np.ndarray) -> pa.Array:
    """Paths of the open ones among ``node``, null for the others."""
    found = np.full(len(node), None, object)
    for k, value in prefix.items():
        found[node == k] = value
    return pa.array(found, pa.binary())


def _peel_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, n, least id, comma-joined ids), sorted by path and least id. The lists of one
    path are hashed one after the other; only the digest is held."""
    parts, n, least, ends, digest, last = [], [], [], [], None, None
    for batch in batches:
        fresh = []
        for k, (path, count, low, text) in enumerate(zip(*(batch.column(i) for i in range(4)), strict=True)):
            path = path.as_buffer()
            if last is not None and path.equals(last):
                digest.update(b",")
                n[-1] += count.as_py()
            else:
                if digest:
                    ends.append(digest.hexdigest())
                digest, last = hashlib.sha256(), path
                fresh.append(k)
                n.append(count.as_py())
                least.append(low.as_py())
            digest.update(text.as_buffer())
        parts.append(batch.column(0).take(pa.array(fresh, pa.int64())).cast(pa.large_binary()))
    if digest:
        ends.append(digest.hexdigest())
        yield from peel(pa.chunked_array(parts).combine_chunks(), np.array(n), np.array(least), np.array(ends, object))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations``: conv_id, path (as from :func:`paths`; a null path
    is the empty one), every conv_id once and not null.

    One row per distinct prefix, the empty one included: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (of the root: null), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, members
    but one times the words of the node's last turn) and ``ends_sha256`` (of the ascending,
    comma-joined ids of the members that end there). An empty table gives an empty result. The
    ids that end at one node are hashed in sequence by one task, as lists of up to ``CHUNK``.
    """
    spark = conversations.sparkSession
    listed = materialize(
        conversations.groupBy(
            F.coalesce("path", F.lit(b"")).alias("path"), (F.col("conv_id") - F.pmod("conv_id", F.lit(CHUNK))).alias("_chunk")
        )
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("path", F.size("ids").cast("bigint").alias("n"), F.col("ids")[0].alias("low"),
                F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")),
        "conversation-ends",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialize(
        listed.repartitionByRange(parts, "path").sortWithinPartitions("path", "low")
        .mapInArrow(_peel_partition, NODE_SCHEMA),
        "trie-nodes",
    )
    whole = checked_broadcast(_merged(nodes.where("open")), "open-nodes")
    closed = nodes.where(~F.col("open")).unionByName(whole, allowMissingColumns=True)
    over = whole.select(F.col("path").alias("parent"), F.col("conv_id").alias("_over"))
    return closed.join(over, "parent", "left").select(
        "conv_id", "depth", F.coalesce("_over", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256",
    )


def _merged(opened: DataFrame) -> DataFrame:
    """Open nodes, merged over partitions; their sums then hold what open nodes below them add."""
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    nodes = materialize(
        opened.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in counts),
            F.max("words").alias("words"), F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256"),
        ).withColumn("parent", F.when(F.col("depth") > 0, F.substr("path", F.lit(1), ((F.col("depth") - 1) * RECORD).cast("int")))),
        "merged-nodes",
    )
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_open"))
    full = nodes.join(below, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_open", F.lit(0)))
    adds = full.select(
        F.explode(F.transform(
            F.sequence(F.lit(0), F.col("depth").cast("int")),
            lambda d: F.sha2(F.substr("path", F.lit(1), d * RECORD), 256),
        )).alias("_at"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ).groupBy("_at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return full.drop("n_leaves", "saved_tokens", "_open", "words").withColumn("_at", F.sha2("path", 256)).join(adds, "_at").drop("_at")
