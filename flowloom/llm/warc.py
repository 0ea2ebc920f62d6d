"""WARC archives of pages: a writer that stores equal payloads once, and a salvage reader.

Every record is a gzip member of its own. The reader checks each record (member checksum, header,
length, block and payload digest). After a failed check it searches for the next place where a
whole valid record begins, at a member's magic bytes or at a version line, goes on from there,
and logs the bytes in between as a quarantined gap.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.base import text_or_empty
from flowloom.llm.files import make_folder, shard_names, write_file
from flowloom.workspace import materialize

# Fixed values of the format.
VERSION = b"WARC/1.0"
MEMBER = b"\x1f\x8b\x08"
PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BREAK = b"\r\n"

FILE_BYTES = 64 << 20
PIECE = 64 << 10
START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")
ID = re.compile(rb"<urn:page:(-?\d+)>")


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, which has the payload's length and digest only."""
    head = BREAK.join([
        b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b"",
    ])
    block = head if refers_to is not None else head + payload
    lines = [
        VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url:
        lines.append(b"WARC-Target-URI: " + re.sub(r"\s", "%20", url).encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE]
    lines += [
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"WARC-Block-Digest: sha1:" + digest(block).encode(),
        b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block), b"", b"",
    ]
    return BREAK.join(lines) + block + BREAK + BREAK


def member(content: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


class Damage(ValueError):
    """A failed check."""


def _fields(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(BREAK)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line")
        found[name.strip().lower()] = value.strip()
    return found


def _number(digits: bytes, what: str) -> int:
    """A number that fits a 64-bit column."""
    if not re.fullmatch(rb"-?[0-9]{1,19}", digits) or not -(1 << 63) <= int(digits) < 1 << 63:
        raise Damage(what)
    return int(digits)


def _ascii(value: bytes, what: str) -> str:
    if not value.isascii():
        raise Damage(what)
    return value.decode()


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at ``at``, and where it ends."""
    if not re.compile(rb"WARC/[0-9]\.[0-9]\r\n").match(data, at):
        raise Damage("version line")
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        raise Damage("header end")
    fields = _fields(data[at:body])
    length = _number(fields.get(b"content-length", b""), "length")
    begin, end = body + 4, body + 4 + length
    if length < 0:
        raise Damage("length")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("record end")
    block = data[begin:end]
    if b"warc-block-digest" in fields and fields[b"warc-block-digest"] != b"sha1:" + digest(block).encode():
        raise Damage("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = _ascii(fields.get(b"warc-type", b""), "record type")
    said = _ascii(fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:"), "payload digest")
    size = len(payload)
    if kind == "revisit":
        size, payload = _number(_fields(http).get(b"content-length", b""), "stated length"), None
        if size < 0:
            raise Damage("stated length")
    elif said and said != digest(payload):
        raise Damage("payload digest")
    name, other = ID.match(fields.get(b"warc-record-id", b"")), ID.match(fields.get(b"warc-refers-to", b""))
    return {
        "page_id": _number(name[1], "id") if name else None, "record_type": kind, "payload_bytes": size,
        "payload_digest": said, "refers_to": _number(other[1], "referred id") if other else None, "payload": payload,
        "url": fields.get(b"warc-target-uri", b"").decode(errors="replace") or None,
    }, end + 4


def unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and where it ends."""
    reader, content = zlib.decompressobj(31), []
    place = at
    try:
        while not reader.eof:
            piece = data[place : place + PIECE]
            if not piece:
                raise Damage("member end")
            content.append(reader.decompress(piece))
            place += len(piece)
    except zlib.error as error:
        raise Damage(f"member: {error}") from None
    return b"".join(content), place - len(reader.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, fields) for every valid record and ("gap", begin, end, reason) for
    the bytes between them, in order. A member may hold several records; one that fails in part
    gives its valid records and counts as a gap too."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found, end = [], at
        try:
            if data.startswith(MEMBER, at):
                content, end = unpack(data, at)
                found = list(_inside(content))
                if not any(kind == "record" for kind, *_ in found):
                    raise Damage(str(found[0][3]) if found else "empty member")
            else:
                fields, end = parse(data, at)
                found = [("record", at, end, fields)]
        except Damage as damage:
            if gap is None:
                gap, reason = at, str(damage)
            later = START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for kind, _, _, what in found:
            yield kind, at, end, what
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _inside(content: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records of a member's content, found again at version lines after damage."""
    at, gap, reason = 0, None, ""
    version = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
    while at < len(content):
        try:
            fields, end = parse(content, at)
        except Damage as damage:
            if gap is None:
                gap, reason = at, str(damage)
            later = version.search(content, at + 1)
            at = later.start() if later else len(content)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, fields
        at = end
    if gap is not None:
        yield "gap", gap, len(content), reason


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url",
    smallest: int = 0, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for every row and return the files written: ``name``, ``n_records``,
    ``n_bytes``.

    Of rows with equal payloads of at least ``smallest`` bytes, that with the smallest id is the
    response and the others revisit it. A null html is the empty payload. A row with a null id
    revisits any row with an id; rows that repeat an id with its payload are responses each.
    """
    make_folder(folder)
    html = text_or_empty(html_col)
    url = F.col(url_col) if url_col else F.lit(None)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("_id"), url.cast("string").alias("_url"), html.alias("_html"), F.sha1(html).alias("_sha"),
    )
    keyed = materialize(
        pages.select(F.col(id_col).cast("bigint").alias("_id"), html.alias("_html"))
        .where(F.octet_length("_html") >= smallest).select("_id", F.sha1("_html").alias("_sha")),
        "payload-keys",
    )
    shared = materialize(
        keyed.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_sha", "_first"),
        "shared-payloads",
    )
    revisits = keyed.join(shared, "_sha").where(~F.col("_id").eqNullSafe(F.col("_first"))).select(
        F.col("_id").alias("_own"), F.col("_sha").alias("_own_sha"), "_first"
    ).distinct()
    placed = rows.join(
        revisits.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_sha") == F.col("_own_sha")), "left"
    ).select("_id", "_url", "_html", "_first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size, files = shard_names(folder, ".warc.gz"), [], 0, []

        def close():
            path = name(len(files))
            write_file(path, b"".join(held))
            files.append({"name": path.rsplit("/", 1)[1], "n_records": len(held), "n_bytes": size})

        for batch in batches:
            for one, at, text, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                content = record(one.as_py(), at.as_py(), bytes(text.as_buffer() or b""), first.as_py())
                held.append(member(content))
                size += len(held[-1])
                if size >= file_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_pylist(files, schema=FILES)

    return materialize(placed.mapInArrow(write, "name string, n_records bigint, n_bytes bigint"), "archives")


FILES = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
SCHEMA = (
    "kind string, file string, begin bigint, end bigint, reason string, page_id bigint, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, url string, payload binary"
)
ARROW = pa.schema([
    ("kind", pa.string()), ("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
    ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])
ROWS = 500


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """Every valid record (``kind`` "record") and every quarantined stretch of bytes ("gap", with
    its ``reason``) of the archives in a folder, or of those that ``files`` names. ``begin`` and
    ``end`` are places in the file. A folder without archives gives no rows."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    raw = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for kind, begin, end, what in salvage(bytes(content.as_buffer() or b"")):
                    row = {"kind": kind, "file": name, "begin": begin, "end": end}
                    if kind == "gap":
                        row["reason"] = what
                    else:
                        row |= what
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    found = raw.mapInArrow(read, SCHEMA)
    return found if files is None else found.join(files.select(F.col("name").alias("file")), "file", "left_semi")
