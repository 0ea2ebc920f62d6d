"""Token ids in directly addressable binary files.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every token; a
continuation bitmap marks the tokens that have more, and those tokens' next chunks make up the
next level, and so on. A rank directory stores the number of marks before every 512th place, so
the place of any token on every level is found from one directory entry and at most 64 bytes of
bitmap; no block is ever decoded to reach a token.

A file holds whole documents: magic, counts, document ids, document starts, then per level its
size, chunks, bitmap and directory. All numbers are little-endian.
"""

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.base import text_or_empty
from flowloom.llm.chunk_encoder import Encoder
from flowloom.llm.files import make_folder, shard_names, write_file
from flowloom.workspace import materialize

MAGIC = b"TOKDAC01"
STRIDE = 512  # bits of a bitmap to one entry of its rank directory
SHARD_TOKENS = 4 << 20
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def pack(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """File content for documents ``ids[starts[i]:starts[i + 1]]``. A null id is kept as such."""
    known = np.array([x is not None for x in doc_ids], bool)
    named = np.array([0 if x is None else x for x in doc_ids], np.int64)
    parts = [
        MAGIC, np.array([len(ids), len(doc_ids)], np.int64).tobytes(),
        named.tobytes(), np.packbits(known).tobytes(), starts.astype(np.int64).tobytes(),
    ]
    rest = ids.astype(np.uint32)
    levels = []
    while len(rest) or not levels:
        more = rest > 0xFF
        marks = np.packbits(more, bitorder="little")
        marks = np.concatenate([marks, np.zeros(-len(marks) % (STRIDE // 8), np.uint8)])
        ones = ONES[marks].reshape(-1, STRIDE // 8).sum(1, dtype=np.int64)
        levels += [
            np.array([len(rest)], np.int64).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(),
            marks.tobytes(), (np.cumsum(ones) - ones).astype(np.int64).tobytes(),
        ]
        rest = rest[more] >> 8
    count = np.array([len(levels) // 4], np.int64).tobytes()
    return b"".join([*parts, count, *levels])


class TokenFile:
    """Random access to the tokens of one file's content."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self._buffer, self._at = content, 8
        self.n_tokens, self.n_docs = self._take(np.int64, 2).tolist()
        named = self._take(np.int64, self.n_docs).tolist()
        known = np.unpackbits(self._take(np.uint8, -(-self.n_docs // 8)))[: self.n_docs]
        self.doc_ids = [x if k else None for x, k in zip(named, known.tolist(), strict=True)]
        self.starts = self._take(np.int64, self.n_docs + 1)
        self._levels = []
        for _ in range(int(self._take(np.int64, 1)[0])):
            size = int(self._take(np.int64, 1)[0])
            words = -(-size // STRIDE)
            self._levels.append((
                self._take(np.uint8, size), self._take(np.uint8, words * STRIDE // 8),
                self._take(np.int64, words),
            ))

    def _take(self, kind, count: int) -> np.ndarray:
        found = np.frombuffer(self._buffer, kind, count, self._at)
        self._at += found.nbytes
        return found

    @staticmethod
    def _rank(marks: np.ndarray, directory: np.ndarray, place: int) -> int:
        """Marks before ``place``."""
        block = place // STRIDE
        if block >= len(directory):
            return int(directory[-1]) + int(ONES[marks[-(STRIDE // 8):]].sum()) if len(directory) else 0
        first, byte = block * STRIDE // 8, place // 8
        ones = int(directory[block]) + int(ONES[marks[first:byte]].sum(dtype=np.int64))
        return ones + int(marks[byte] & ((1 << place % 8) - 1)).bit_count()

    def token(self, place: int) -> int:
        """The id at one place."""
        value, shift = 0, 0
        for chunks, marks, directory in self._levels:
            value |= int(chunks[place]) << shift
            if not marks[place // 8] >> place % 8 & 1:
                break
            place, shift = self._rank(marks, directory, place), shift + 8
        return value

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids at places [first, end)."""
        found = np.zeros(end - first, np.uint32)
        where, shift = None, 0
        for chunks, marks, directory in self._levels:
            value = chunks[first:end].astype(np.uint32) << np.uint32(shift)
            if where is None:
                found |= value
            else:
                found[where] |= value
            bits = np.unpackbits(marks[first // 8 : -(-end // 8)], bitorder="little")
            more = np.flatnonzero(bits[first % 8 : first % 8 + end - first])
            if not len(more):
                break
            where = more if where is None else where[more]
            first = self._rank(marks, directory, first)
            end, shift = first + len(more), shift + 8
        return found

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its memory of chunks, per Python worker."""
    return Encoder(path)


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts in ascending id order and return the list of files: ``name``,
    ``part``, ``shard``, ``n_docs``, ``n_tokens``, ``first_token`` (ids in all files before).

    A null text is the empty text. Null ids come first; rows of equal id are ordered by text.
    An empty table gives an empty list. Documents are never split over files, and a file is
    closed once it has ``shard_tokens`` ids.
    """
    spark = docs.sparkSession
    make_folder(folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
        .repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = shard_names(folder, ".tok")
        part = int(name(0).rsplit("-", 2)[1])
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        files = []

        def close():
            ids = np.concatenate([x[1] for x in held])
            starts = np.concatenate([[0], *[x[2] for x in held]]).cumsum()
            names = [y for x in held for y in x[0]]
            path = name(len(files))
            write_file(path, pack(ids, names, starts))
            files.append((path.rsplit("/", 1)[1], part, len(files), len(names), len(ids)))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = encoder(tokenizer).encode(*flat_texts(batch.column(1)))
            if end_id is not None:
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                ids, counts = full, counts + 1
            held.append((batch.column(0).to_pylist(), ids, counts))
            if sum(len(x[1]) for x in held) >= shard_tokens:
                close()
        if held:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(FILE_COLUMNS, x, strict=True)) for x in files], schema=FILE_ARROW
        )

    files = materialize(placed.mapInArrow(write, FILE_SCHEMA), "token-files")
    # Sums over the shards of a part, then over parts: a window never sees more than one row
    # per part or per file of a part.
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
        .select("part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    return files.withColumn(
        "_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    ).join(before, "part").select(
        *FILE_COLUMNS, (F.col("_before") + F.col("_inside")).alias("first_token")
    )


FILE_COLUMNS = ["name", "part", "shard", "n_docs", "n_tokens"]
FILE_SCHEMA = "name string, part bigint, shard bigint, n_docs bigint, n_tokens bigint"
FILE_ARROW = pa.schema([("name", pa.string()), *[(c, pa.int64()) for c in FILE_COLUMNS[1:]]])


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read the listed files back. One row per document: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` (unsigned crc32 of its ids as
    little-endian 32-bit integers), ``shard_name``, ``position`` in the file, and with
    ``with_ids`` the ids themselves."""
    spark = files.sparkSession
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    fields = [("shard_name", pa.string()), ("doc_id", pa.int64()), ("position", pa.int64()),
              ("_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "shard_name string, doc_id bigint, position bigint, _start bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(memoryview(content.as_buffer()))
                n = file.n_docs
                found = [file.document(k) for k in range(n)] if with_ids else None
                sums = [zlib.crc32((found[k] if with_ids else file.document(k)).astype("<u4"))
                        for k in range(n)]
                columns = [
                    pa.array([name] * n, pa.string()), pa.array(file.doc_ids, pa.int64()),
                    pa.array(np.arange(n)), pa.array(file.starts[:-1]),
                    pa.array(np.diff(file.starts)), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content")
    rows = named.mapInArrow(read, schema)
    listed = files.select(F.col("name").alias("shard_name"), "first_token")
    return rows.join(listed, "shard_name").select(
        "doc_id", (F.col("first_token") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32",
        "shard_name", "position", *["ids"] * with_ids,
    )
