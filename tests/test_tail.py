"""A file that grows while a stream follows it."""

import random

import pytest

from flowloom.sources.tail import GrowingCsvReader, tail_flows
from pyspark.sql.types import StructType

COLUMNS = {"src ip": "string", "n": "int", "t": "double", "none": "string"}


class Run:
    """A stream that is started anew for every trigger, from its checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.root, self.folder = spark, str(tmp_path), tmp_path / "in"
        self.folder.mkdir()
        self.options = {"start_at": "start", **options}

    def trigger(self):
        stream = tail_flows(self.spark, str(self.folder), COLUMNS, **self.options)
        query = (
            stream.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted((r["src ip"], r["n"], r["t"] == r["arrived"], None if r["t"] == r["arrived"] else r["t"])
                      for r in self.spark.read.parquet(f"{self.root}/out").collect())


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_lines_arrive_once_when_they_are_whole(spark, tmp_path, size):
    run = Run(spark, tmp_path, sliceBytes=size)
    file = run.folder / "flows.csv"
    file.write_bytes(b" src ip, n ,t\n\xe9,1,5.5\nb,2,\nwrong,1\nc,3,7\nd,")
    first = [("b", 2, True, None), ("c", 3, False, 7.0), ("é", 1, False, 5.5)]
    assert run.trigger() == first
    with file.open("ab") as out:
        out.write(b"4,8\r\n\ne,5,9,too wide\n\"f,\",x,10\n")
    (run.folder / "later.csv").write_bytes(b"t,src ip\n1,z\n")
    (run.folder / "_draft.csv").write_bytes(b"t,src ip\n1,hidden\n")
    second = sorted([*first, ("d", 4, False, 8.0), ("f,", None, False, 10.0), ("z", None, False, 1.0)], key=str)
    assert sorted(run.trigger(), key=str) == second
    assert sorted(run.trigger(), key=str) == second  # nothing new
    (run.folder / "later.csv").write_bytes(b"t,src ip\n2,y\n3,x")  # replaced by as long a file: not seen
    file.write_bytes(b"src ip,n,t\nq,6,1\n")  # replaced by a shorter one: read from its start
    assert sorted(run.trigger(), key=str) == sorted([*second, ("q", 6, False, 1.0)], key=str)


def test_from_the_end_only_later_lines_are_read(spark, tmp_path):
    run = Run(spark, tmp_path)
    file = run.folder / "flows.csv"
    file.write_bytes(b"src ip,n,t\na,1,1\n")
    reader = GrowingCsvReader(StructType(), {"path": str(run.folder)})
    start = reader.initialOffset()
    with file.open("ab") as out:
        out.write(b"b,2,2\nc,")
    (part,) = reader.partitions(start, reader.latestOffset())
    assert file.read_bytes()[part.begin : part.end] == b"b,2,2\n"


def test_slices_hold_every_line_once(tmp_path):
    rnd = random.Random(2)
    lines = [f"{k}{'x' * rnd.randint(0, 30)}" for k in range(300)]
    (tmp_path / "a.csv").write_text("name\n" + "\n".join(lines) + "\n")
    schema = StructType().add("name", "string").add("arrived", "double").add("source_file", "string")
    for size in (1, 7, 50, 1000, 1 << 20):
        reader = GrowingCsvReader(schema, {"path": str(tmp_path), "startat": "start", "slicebytes": str(size)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        found = [x for part in parts for batch in reader.read(part) for x in batch.column(0).to_pylist()]
        assert found == lines
