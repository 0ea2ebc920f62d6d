"""Labelled flow CSVs: header inspection, validation, tolerant reads and replay streams."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.constants import FEATURE_COLUMNS, HEADER_ALIASES, RATE_COLUMNS, STRUCTURAL_COLUMNS
from flowloom.functions.clock import epoch_seconds, parse_timestamps, repair_clock
from flowloom.operators.cleaning import map_labels

ENCODING = "ISO-8859-1"


def canonical_names(header: list[str]) -> dict[str, str]:
    """Raw header cell -> canonical column, for the cells that have one. The first wins."""
    out, taken = {}, set()
    for cell in header:
        name = HEADER_ALIASES.get(cell.strip().lower())
        if name and name not in taken:
            out[cell] = name
            taken.add(name)
    return out


def inspect_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file, found in one job: (file, header, has_ips, has_timestamp, variant,
    has_protocol, n_columns, missing, renames). ``missing`` lists structural columns that no
    header cell stands for, ``renames`` the (cell, name) pairs of the cells that are known."""
    lines = spark.read.option("encoding", ENCODING).text(paths).select(
        F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("_at")
    )
    first = lines.groupBy("file").agg(F.min_by("value", "_at").alias("header"))
    cells = F.transform(F.split("header", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '^\\ufeff|"', ""))))

    def has(*names):
        return F.arrays_overlap(cells, F.array(*[F.lit(n) for n in names]))

    def spelled(column):
        return [k for k, v in HEADER_ALIASES.items() if v == column]

    ips = has(*spelled("src_ip")) & has(*spelled("dst_ip"))
    variant = (
        F.when(ips & has("flow id"), "traffic_labelling")
        .when(~ips & has(*spelled("dst_port")), "machine_learning_cve").otherwise("unknown")
    )
    known = F.create_map(*[F.lit(x) for pair in HEADER_ALIASES.items() for x in pair])
    pairs = F.filter(
        F.transform(cells, lambda c: F.struct(c.alias("cell"), F.element_at(known, c).alias("name"))),
        lambda p: p["name"].isNotNull(),
    )
    return first.select(
        "file", "header", ips.alias("has_ips"), has("timestamp").alias("has_timestamp"), variant.alias("variant"),
        has(*spelled("protocol")).alias("has_protocol"), F.size(cells).alias("n_columns"),
        F.array_except(F.array(*[F.lit(c) for c in STRUCTURAL_COLUMNS]), F.transform(pairs, lambda p: p["name"])).alias("missing"),
        pairs.alias("renames"),
    )


def validate_files(spark: SparkSession, paths: list[str], require_ips: bool = True) -> list:
    """The inspection rows, or an error that names every file no host graph can be built
    from. The report has one row per file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    if missing:
        raise FileNotFoundError(f"missing flow files: {missing}")
    report = inspect_files(spark, paths).collect()
    unfit = [r.file for r in report if not (r.has_ips and r.has_timestamp)]
    if require_ips and unfit:
        raise ValueError(f"no addresses or timestamps, so no host graph is possible: {unfit}")
    return report


def _split_header(line: str) -> list[str]:
    return [c.strip().strip('"') for c in line.lstrip("﻿").split(",")]


def read_variant(spark: SparkSession, files: list[str], header: str) -> DataFrame:
    """All files that share one header line, as text under canonical names. Lines of another
    width are dropped; the width test needs the full line, so the parser must not prune."""
    cells = _split_header(header)
    names = canonical_names(cells)
    raw = [f"_c{i}" for i in range(len(cells))]
    df = (
        spark.read.schema(", ".join(f"{c} string" for c in raw))
        .options(header=True, encoding=ENCODING, mode="DROPMALFORMED", columnPruning=False,
                 ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        .csv(files)
    )
    chosen, used = [], set()
    for column, cell in zip(raw, cells):
        if cell in names and names[cell] not in used:
            used.add(names[cell])
            chosen.append(F.col(column).alias(names[cell]))
    wanted = STRUCTURAL_COLUMNS + FEATURE_COLUMNS + RATE_COLUMNS
    named = df.select(*chosen, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))
    return named.select(*[c for c in wanted if c in named.columns], "source_file")


def read_flows(spark: SparkSession, paths: list[str], require_ips: bool = True) -> DataFrame:
    """One table over all files; a column a file lacks is null there."""
    report = validate_files(spark, paths, require_ips)
    groups: dict[str, list[str]] = {}
    for row in report:
        groups.setdefault(row.header, []).append(row.file)
    parts = [read_variant(spark, sorted(files), header) for header, files in sorted(groups.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def load_labelled(
    spark: SparkSession, paths: list[str], taxonomy: str, days: dict[str, str] | None = None,
    fix_clock: bool = True, pm_hours: tuple = (1, 7),
) -> DataFrame:
    """Read, map labels, parse and repair the clock, add ``t`` and ``capture_day``."""
    rows = map_labels(read_flows(spark, paths), taxonomy)
    parsed = parse_timestamps(rows, "timestamp", "ts")
    fixed = repair_clock(parsed, "ts", "timestamp", pm_hours).drop("moved") if fix_clock else parsed
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    if days:
        named = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
        stem = F.coalesce(named[F.col("source_file")], stem)
    return fixed.where(F.col("ts").isNotNull()).withColumns({
        "t": epoch_seconds(F.col("ts")), "capture_day": stem,
    })


def replay_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Closed CSV files as a stream, a few per trigger, oldest first. Lines of the wrong width
    are dropped; a row without ``t`` takes its arrival time."""
    stream = (
        spark.readStream.schema(schema)
        .options(header=True, encoding=ENCODING, mode="DROPMALFORMED", columnPruning=False, maxFilesPerTrigger=files_per_trigger)
        .csv(folder)
    )
    if "t" in stream.columns:
        return stream.withColumn("t", F.coalesce(F.col("t"), F.unix_timestamp(F.current_timestamp())))
    return stream.withColumn("t", F.unix_timestamp(F.current_timestamp()))


def in_time_order(flows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The replay order; a limit keeps the earliest rows and is pushed into the sort."""
    ordered = flows.orderBy(*order)
    return ordered.limit(limit) if limit else ordered
