import gzip
import os
import random

import pyarrow as pa
import pytest

from flowloom.llm import warc
from flowloom.workspace import new_path

SCHEMA = "page_id bigint, url string, html string, file string, kind string"


def corpus():
    rnd = random.Random(3)
    texts = ["", "<p>é</p>", "WARC/1.0\r\nfake", "x" * 200_000, "\x1f\x08 odd"] + [f"page {k} " * rnd.randint(1, 40) for k in range(20)]
    rows = [(k, rnd.choice([None, f"http://a/{k} b"]), rnd.choice(texts), "f", "k") for k in range(80)]
    return rows + [(200, None, None, "f", "k"), (None, None, texts[8], "f", "k"), (None, None, "only without id", "f", "k"), rows[5], rows[5]]


def plain(rows):
    out = []
    for r in rows:
        data = (r[2] or "").encode()
        ids = [s[0] for s in rows if (s[2] or "").encode() == data and s[0] is not None]
        first = min(ids) if ids else None
        revisit = first is not None and r[0] != first
        out.append((str(r[0]), len(data), warc.digest(data), "revisit" if revisit else "response", str(first if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("file_bytes", [3000, 64 << 20])
def test_round_trip(spark, file_bytes):
    rows = corpus()
    folder = new_path(spark, "warc")
    files = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, file_bytes=file_bytes)
    got = warc.read_archives(spark, folder, files, with_payload=True).collect()
    assert {r.kind for r in got} == {"record"}
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == plain(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert files.agg({"n_records": "sum"}).first()[0] == len(rows)


def test_small_payloads_are_not_shared(spark):
    folder = new_path(spark, "warc")
    rows = [(1, None, "ab", "", ""), (2, None, "ab", "", ""), (3, None, "abcdef", "", ""), (4, None, "abcdef", "", "")]
    files = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, smallest=5)
    got = {r.page_id: r.record_type for r in warc.read_archives(spark, folder, files).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    folder = new_path(spark, "warc")
    files = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert files.count() == 0 and warc.read_archives(spark, folder, files).count() == 0


def archive(n=30):
    raw = [warc.record(k, None, (f"page {k} " * (k + 1)).encode(), 0 if k % 7 == 6 else None) for k in range(n)]
    return raw, [warc.member(x) for x in raw]


def check(data, lost, total):
    """Records and gaps cover the file in order; only the damaged records are missing."""
    found = list(warc.salvage(data))
    ids = [what["page_id"] for kind, _, _, what in found if kind == "record"]
    assert ids == [k for k in range(total) if k not in lost]
    at = 0
    for _, begin, end, _ in sorted(found, key=lambda x: x[1]):
        assert begin in (at, *[x[1] for x in found]) and end > begin
        at = max(at, end)
    assert at == len(data) and (not lost or any(kind == "gap" for kind, *_ in found))


@pytest.mark.parametrize("seed", range(12))
def test_damaged_members_are_skipped_and_logged(seed):
    rnd = random.Random(seed)
    raw, members = archive()
    lost = set(rnd.sample(range(30), rnd.randint(1, 6)))
    damaged = []
    for k, m in enumerate(members):
        if k in lost:
            kind = rnd.randrange(4)
            if kind == 0:
                m = m[: len(m) // 2]
            elif kind == 1:
                m = b"\x00" * 3 + m[3:]
            elif kind == 2:
                m = m[:-6] + bytes([m[-6] ^ 255]) + m[-5:]
            else:
                m = gzip.compress(raw[k].replace(b"200 OK", b"200 NO", 1))
        damaged.append(m)
    check(b"".join(damaged), lost, 30)


def test_plain_records_and_mixed_members():
    raw, members = archive(12)
    check(b"".join(raw), set(), 12)
    check(b"".join(raw[:4]) + b"junk" + b"".join(raw[5:]), {4}, 12)
    check(b"".join(raw[:4]) + members[4] + raw[5][: -40] + b"".join(members[6:]), {5}, 12)
    several = warc.member(raw[3] + raw[4][:-30] + raw[5])
    check(b"".join(members[:3]) + several + b"".join(members[6:]), {4}, 12)
    assert list(warc.salvage(b"")) == []
    assert [x[0] for x in warc.salvage(os.urandom(5000).replace(b"\x1f", b"\x1e"))] == ["gap"]


def test_any_changed_header_byte_is_a_record_or_a_gap():
    """Also what no 64-bit number or ASCII text can hold ends as damage, never as an error."""
    raw, _ = archive(3)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("record_type", pa.string())])
    data = bytearray(b"".join(raw))
    head = raw[0].index(b"\r\n\r\n")
    places = [*range(head + 120), *range(len(raw[0]), len(raw[0]) + head + 120)]
    for place in places:
        for value in (0xFF, 0x00, ord("9"), ord("-"), ord(":"), 0x0D):
            changed = data.copy()
            changed[place] = value
            found = list(warc.salvage(bytes(changed)))
            records = [what for kind, _, _, what in found if kind == "record"]
            assert len(records) >= 2 and max(end for _, _, end, _ in found) == len(data)
            pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in records], schema)


@pytest.mark.parametrize("field,value", [
    (b"WARC-Type: response", b"WARC-Type: resp\xffonse"), (b"Digest: sha1:", b"Digest: sha1:\xe9"),
    (b"<urn:page:1>", b"<urn:page:%s>" % (b"7" * 30)), (b"<urn:page:1>", b"<urn:page:%s>" % (b"7" * 5000)),
    (b"Content-Length: ", b"Content-Length: " + b"1" * 5000),
])
def test_fields_that_cannot_be_read_are_gaps(field, value):
    raw, _ = archive(3)
    assert field in raw[1]
    check(raw[0] + raw[1].replace(field, value) + raw[2], {1}, 3)
