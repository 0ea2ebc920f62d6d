"""A growing CSV file as a stream.

Spark's file source reads a file once, when it appears. This source follows files that are still
being written: its offset is the number of bytes of each file that were read, always at the end of
a line, so a line that is written in two parts is read once, when it is whole. Byte ranges are
cut into slices that tasks read and parse in Arrow batches; nothing but offsets reaches the driver.

The offset also holds the time at which it was taken. Rows without a time get that time, so that a
micro-batch that is read again after a failure has the same rows.
"""

import csv as lines
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "growing_csv"
ENCODING = "latin-1"
SLICE = 32 << 20  # bytes a task reads
STEP = 64 << 10  # bytes searched at a time for the last line break
END = b"\n"


@dataclass
class Slice(InputPartition):
    path: str
    begin: int  # where the bytes to read begin, after a line break
    first: int  # of the slice's own lines: the least place at which one may begin,
    stop: int  # and the place from which lines are the next slice's
    end: int
    arrived: float


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that any of Spark's local, HDFS or S3 spellings names."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def last_break(file, low: int, size: int) -> int:
    """The end of the last whole line in bytes [low, size); ``low`` if there is none."""
    high = size
    while high > low:
        begin = max(low, high - STEP)
        file.seek(begin)
        at = file.read(high - begin).rfind(END)
        if at >= 0:
            return begin + at + 1
        high = begin
    return low


def header_of(file) -> tuple[list[str], int]:
    """Trimmed names of the first line and where the second begins; no names while the first
    line is not whole."""
    head = b""
    while END not in head:
        more = file.read(STEP)
        if not more:
            return [], 0
        head += more
    line = head[: head.index(END) + 1]
    return [name.strip() for name in next(lines.reader([line.decode(ENCODING)]))], len(line)


def parse_lines(data: bytes, names: list[str]) -> pa.Table:
    """Whole lines as text columns; lines of another width are dropped."""
    if not data.strip():
        return pa.table({name: pa.array([], pa.string()) for name in names})
    return csv.read_csv(
        pa.py_buffer(data), read_options=csv.ReadOptions(column_names=names, encoding=ENCODING, block_size=max(len(data), 1)),
        parse_options=csv.ParseOptions(invalid_row_handler=lambda row: "skip", ignore_empty_lines=True),
        convert_options=csv.ConvertOptions(column_types={name: pa.string() for name in names}, strings_can_be_null=False),
    )


class GrowingCsvReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [field.name for field in schema.fields if field.name not in ("arrived", "source_file")]
        self.folder, self.suffix = options["path"], options.get("suffix", ".csv")
        self.from_end = options.get("startat", "end") == "end"
        self.slice = int(options.get("slicebytes", SLICE))
        self.told: dict | None = None  # the newest offset of this run

    def _sizes(self) -> dict[str, int]:
        system, folder = open_path(self.folder)
        prefix = self.folder[: len(self.folder) - len(folder)] if self.folder.endswith(folder) else ""
        found = system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and f.base_name[0] not in "._"]
        return {prefix + f.path: f.size for f in files}

    def _whole(self, path: str, low: int, size: int) -> int:
        system, place = open_path(path)
        with system.open_input_file(place) as file:
            return last_break(file, low, size)

    def initialOffset(self) -> dict:
        """Files that already exist are followed from their end, unless ``startAt`` is ``start``."""
        files = {path: self._whole(path, 0, size) for path, size in self._sizes().items()} if self.from_end else {}
        return {"files": json.dumps(files, sort_keys=True), "at": 0.0}

    def latestOffset(self) -> dict:
        """What can be read now. A file shorter than what was read of it was replaced, and is
        read from its start."""
        before = json.loads(self.told["files"]) if self.told else {}
        files, now = {}, time.time()
        for path, size in self._sizes().items():
            low = before.get(path, 0)
            files[path] = self._whole(path, low if low <= size else 0, size)
        if self.told is None or files != before:
            self.told = {"files": json.dumps(files, sort_keys=True), "at": now}
        return self.told

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        done, now = json.loads(start["files"]), json.loads(end["files"])
        slices = []
        for path, stop in sorted(now.items()):
            low = done.get(path, 0)
            low = 0 if low > stop else low
            slices += [
                Slice(path, low, at, min(at + self.slice, stop), stop, end["at"]) for at in range(low, stop, self.slice)
            ]
        return slices

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the slice. Only lines before the offset are read, so the last is whole."""
        system, place = open_path(part.path)
        with system.open_input_file(place) as file:
            names, body = header_of(file)
            begin = max(part.first, body)
            if begin >= part.stop:
                return
            if begin > max(part.begin, body):  # the line that runs into the slice is the one before's
                begin = self._next_line(file, begin - 1, part.end)
            stop = part.stop if part.stop >= part.end else self._next_line(file, part.stop - 1, part.end)
            file.seek(begin)
            data = file.read(max(0, stop - begin))
        table = parse_lines(data, names)
        n = table.num_rows
        taken = [table[name] if name in names else pa.nulls(n, pa.string()) for name in self.columns]
        taken += [pa.array([part.arrived] * n, pa.float64()), pa.array([part.path.rsplit("/", 1)[-1]] * n)]
        out = pa.table(taken, names=[*self.columns, "arrived", "source_file"])
        yield from out.to_batches(max_chunksize=10_000)

    @staticmethod
    def _next_line(file, at: int, end: int) -> int:
        """Where the line after the one that holds ``at`` begins."""
        file.seek(at)
        while at < end:
            piece = file.read(min(STEP, end - at))
            found = piece.find(END)
            if found >= 0:
                return at + found + 1
            at += len(piece)
        return end

    def commit(self, end: dict) -> None:
        pass


class GrowingCsv(DataSource):
    """Options: ``path`` (a folder), ``suffix``, ``startAt`` (``end``, the default, or ``start``) and
    ``sliceBytes``. The schema names the text columns, then ``arrived`` and ``source_file``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> GrowingCsvReader:
        return GrowingCsvReader(schema, {k.lower(): v for k, v in self.options.items()})


def tail_flows(spark: SparkSession, folder: str, columns: dict[str, str], start_at: str = "end", **options) -> DataFrame:
    """Rows that are appended to the CSV files of a folder. ``columns``: type of each column, by its
    header name; one that a file lacks is null there, and so is a value that does not fit. Lines of
    another width than the header's are dropped; a row without ``t`` takes its arrival time."""
    spark.dataSource.register(GrowingCsv)
    schema = ", ".join([*(f"`{name}` string" for name in columns), "arrived double", "source_file string"])
    rows = spark.readStream.format(NAME).schema(schema).options(path=folder, startAt=start_at, **options).load()
    typed = [F.expr(f"try_cast(nullif(trim(`{name}`), '') AS {kind})").alias(name) for name, kind in columns.items() if name != "t"]
    kind = columns.get("t", "double")
    told = F.expr(f"try_cast(nullif(trim(`t`), '') AS {kind})") if "t" in columns else F.lit(None)
    return rows.select(*typed, F.coalesce(told, F.col("arrived").cast(kind)).alias("t"), "arrived", "source_file")
