"""Sources, sinks and streams over the driver tables."""

import datetime

from pyspark.sql import functions as F

from flowloom.catalog.evaluation import rounded
from flowloom.catalog.graphs import K, r
from flowloom.catalog.operations import BASE, CFG, CONFIGURED, HOSTS, INCIDENTS, LIMITS, ORDER, blocked, incidents
from flowloom.catalog.registry import query
from flowloom.catalog.tables import CLEAN, FLOWS, LEDGER, LIVE, LIVE_SCORED, TIE, WEEK, clean, flows, ledger, live, live_scored, table, windowed, windowed_sql, with_sql
from flowloom.operators import hosts, views
from flowloom.sources import csv, dumps, packets, tables, tail
from flowloom.sources.sinks import ResultSink
from flowloom.streaming import feeds, state
from flowloom.streaming.stepped import SteppedState
from flowloom.streaming.windows import WindowCloser, run_to_end, tumbling_counts
from flowloom.workspace import new_path

WIDE = {"src_ip": " Source IP", "dst_ip": " Destination IP", "src_port": " Source Port", "dst_port": " Destination Port", "protocol": " Protocol",
        "timestamp": " Timestamp", "duration_us": " Flow Duration", "fwd_packets": " Total Fwd Packets", "fwd_bytes": "Total Length of Fwd Packets", "label": " Label"}
SHORT = {"src_ip": "Src IP", "dst_ip": "Dst IP", "src_port": "Src Port", "dst_port": "Dst Port", "protocol": "Protocol", "timestamp": "Timestamp",
         "fwd_packets": "Total Fwd Packets", "syn": "SYN Flag Count", "label": "Label"}


def flow_files(spark, sf):
    """The flow view written as CSV files under two header spellings, and one file set that
    has no addresses."""
    f = flows(spark, sf).withColumns({
        "timestamp": F.date_format(F.timestamp_seconds("t"), "dd/MM/yyyy HH:mm:ss"),
        "label": F.concat(F.lit(" "), F.when(F.col("y") == 3, "Bot").when(F.col("y") == 4, "SSH-Patator").when(F.col("y") == 5, "Infiltration").otherwise(F.col("label"))),
    })
    root = new_path(spark, "csv")

    def write(rows, names, name):
        rows.select(*[F.col(k).alias(v) for k, v in names.items()]).write.options(header=True).csv(f"{root}/{name}")

    write(f.where("k1 % 2 = 0").withColumn("flow_id", F.col("k1")), {"flow_id": "Flow ID", **WIDE}, "wide")
    write(f.where("k1 % 2 = 1"), SHORT, "short")
    write(f, {"dst_port": " Destination Port", "fwd_packets": "Total Fwd Packets", "label": "Label"}, "bare")
    return root


@query("s01_load_flow_csv", with_sql(FLOWS) + " SELECT CASE y WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'PortScan' WHEN 3 THEN 'Botnet' ELSE 'SSHBrute' END AS label, count(*) AS n, sum(t)::BIGINT AS t_sum, round(sum(fwd_packets), 2) AS packets, count(*) FILTER (k1 % 2 = 0) AS with_duration, count(*) FILTER (k1 % 2 = 1) AS with_syn FROM flows WHERE y <> 5 GROUP BY 1")
def _(spark, sf):
    root = flow_files(spark, sf)
    f = csv.load_labelled(spark, [f"{root}/wide", f"{root}/short"], "cicids6")
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t_sum"), r(F.sum(F.col("fwd_packets").cast("double")), "packets", 2),
                                  F.count("duration_us").alias("with_duration"), F.count("syn").alias("with_syn"))


@query("s03_inspect_files", "SELECT * FROM (VALUES ('traffic_labelling', true, true), ('unknown', true, true), ('machine_learning_cve', false, false)) v(variant, has_ips, has_timestamp)")
def _(spark, sf):
    root = flow_files(spark, sf)
    return csv.inspect_files(spark, [f"{root}/wide", f"{root}/short", f"{root}/bare"]).select("variant", "has_ips", "has_timestamp").distinct()


@query("s02_header_names", with_sql(FLOWS) + " SELECT 'dst_port' AS name, count(DISTINCT dst_port) AS n, count(*) AS n_rows FROM flows UNION ALL SELECT 'src_ip', count(DISTINCT src_ip), count(*) FROM flows")
def _(spark, sf):
    root = flow_files(spark, sf)
    f = csv.read_flows(spark, [f"{root}/wide", f"{root}/short"])
    counts = f.agg(F.count_distinct("dst_port").alias("dst_port"), F.count_distinct("src_ip").alias("src_ip"), F.count(F.lit(1)).alias("n_rows"))
    return counts.unpivot(["n_rows"], ["dst_port", "src_ip"], "name", "n")


@query("s04_unfit_files", "SELECT * FROM (VALUES ('bare', false, true), ('short', true, false), ('wide', true, false)) v(folder, has_ips, refused)")
def _(spark, sf):
    """The check refuses files without addresses before any flow is read, and only those."""
    root = flow_files(spark, sf)
    folders = ["bare", "short", "wide"]

    def refused(folder):
        try:
            csv.validate_files(spark, [f"{root}/{folder}"])
            return False
        except ValueError:
            return True

    report = csv.inspect_files(spark, [f"{root}/{folder}" for folder in folders])
    found = report.groupBy(F.regexp_extract("file", "/(bare|short|wide)/", 1).alias("folder")).agg(F.bool_and("has_ips").alias("has_ips"))
    return found.join(spark.createDataFrame([(f, refused(f)) for f in folders], "folder string, refused boolean"), "folder")


def dump_lines(spark, sf):
    f = live(spark, sf)
    s = lambda c: F.col(c).cast("string")
    kind = F.col("k1") % 6
    head = F.concat(F.lit(" cookie=0x0, duration="), s("duration_sec"), F.lit("s, table=0, n_packets="), s("packet_count"), F.lit(", n_bytes="), s("byte_count"), F.lit(", "))
    ip = F.concat(F.lit(",nw_src="), "src_ip", F.lit(",nw_dst="), "dst_ip")
    tcp = F.concat(F.lit("tcp"), ip, F.lit(",tp_src="), s("src_port"), F.lit(",tp_dst="), s("dst_port"), F.when(F.col("k2") % 2 == 0, ",tcp_flags=0x12").otherwise(",tcp_flags=18"), F.lit(" actions=NORMAL"))
    arp = F.concat(F.lit("arp,arp_spa="), "src_ip", F.lit(",arp_tpa="), "dst_ip", F.lit(" actions=NORMAL"))
    body = F.when(kind == 0, arp).when(kind == 1, F.concat(F.lit("icmp"), ip, F.lit(" actions=drop"))).when(kind == 2, "NXST_FLOW reply (xid=0x4):").otherwise(tcp)
    return f.select("k1", (F.col("k1") % 97).alias("dump_id"), F.concat(head, body).alias("value"))


@query("s06_parse_dump", with_sql(LIVE) + """ SELECT CASE WHEN k1 % 6 = 0 THEN 'ARP' WHEN k1 % 6 = 1 THEN 'ICMP' ELSE 'TCP' END AS protocol, count(*) AS n, sum(packet_count)::BIGINT AS packets, sum(byte_count)::BIGINT AS bytes, round(sum(duration_sec), 2) AS seconds,
  sum(CASE WHEN k1 % 6 > 2 THEN dst_port ELSE 0 END)::BIGINT AS ports, sum(CASE WHEN k1 % 6 > 2 THEN 18 ELSE 0 END)::BIGINT AS flags, 'ovs' AS data_source FROM live WHERE k1 % 6 <> 2 GROUP BY 1""")
def _(spark, sf):
    path = new_path(spark, "dump")
    dump_lines(spark, sf).select("value").write.text(path)
    f = dumps.parse_dump(spark.read.text(path))
    return f.groupBy("protocol", "data_source").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"), r(F.sum("duration_sec"), "seconds", 2),
                                                    F.sum("dst_port").alias("ports"), F.sum("tcp_flags").alias("flags"))


@query("s07_poll_results", with_sql(LIVE) + " SELECT k1 % 97 AS dump_id, count(*) AS lines, count(*) FILTER (k1 % 6 <> 2) AS flows, CASE WHEN count(*) FILTER (k1 % 6 <> 2) > 0 THEN 'ok' ELSE 'ok_empty' END AS status FROM live GROUP BY 1 UNION ALL SELECT 500, 0, 0, 'failed'")
def _(spark, sf):
    failed = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(500).cast("bigint").alias("dump_id"))
    return dumps.poll_results(dump_lines(spark, sf), "dump_id", failed=failed)


@query("s08_replay_order", with_sql(CLEAN) + f" SELECT {K}, t FROM clean")
def _(spark, sf):
    return csv.in_time_order(clean(spark, sf).select(*TIE, "t"), ["t", *TIE])


def drain(stream, spark, name, mode="append"):
    path = new_path(spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("s09_csv_stream", with_sql(FLOWS) + " SELECT src_ip, count(*) AS n, sum(t)::BIGINT AS t_sum FROM flows GROUP BY 1")
def _(spark, sf):
    path = new_path(spark, "tail")
    f = flows(spark, sf).select("src_ip", "dst_ip", "fwd_bytes", "t")
    f.repartition(4).write.options(header=True).csv(path)
    stream = csv.replay_stream(spark, path, "src_ip string, dst_ip string, fwd_bytes double, t bigint", 2)
    return drain(stream, spark, "tail").groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t_sum"))


GROWING = "src_ip,dst_ip,fwd_bytes,t"


def grow_files(spark, sf, root, whole):
    """Each task writes its flows as one CSV file: at first half of its bytes, which ends inside a
    line, later all of them. Every 50th line is too wide, every 40th has no time."""
    from pyspark import TaskContext

    from flowloom.sources.tail import open_path

    def write(batches):
        text = [GROWING]
        for batch in batches:
            for k1, src, dst, size, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text.append(f"{src},{dst},{size},{'' if k1 % 40 == 3 else t}{',x' if k1 % 50 == 7 else ''}")
        content = "\n".join([*text, ""]).encode("latin-1")
        system, folder = open_path(root)
        system.create_dir(folder, recursive=True)
        place = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        with system.open_output_stream(f"{place}.draft") as out:
            out.write(content if whole else content[: len(content) // 2])
        system.move(f"{place}.draft", f"{place}.csv")
        yield from ()

    rows = flows(spark, sf).select("k1", "src_ip", "dst_ip", "fwd_bytes", "t")
    rows.mapInArrow(write, "k1 bigint").count()


@query("s09_growing_csv", with_sql(FLOWS) + " SELECT src_ip, count(*) AS n, count(*) FILTER (k1 % 40 <> 3) AS timed, coalesce(sum(t) FILTER (k1 % 40 <> 3), 0)::BIGINT AS t_sum FROM flows WHERE k1 % 50 <> 7 GROUP BY 1")
def _(spark, sf):
    """Files that grow between two triggers: every whole line of the right width arrives once."""
    root, out = new_path(spark, "growing"), new_path(spark, "tailed")
    for whole in (False, True):
        grow_files(spark, sf, root, whole)
        stream = tail.tail_flows(spark, root, {"src_ip": "string", "dst_ip": "string", "fwd_bytes": "double", "t": "double"}, start_at="start")
        (stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start().awaitTermination())
    told = F.col("t") != F.col("arrived")
    return spark.read.parquet(f"{out}/rows").groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(told).alias("timed"), F.coalesce(F.sum(F.when(told, F.col("t"))), F.lit(0)).cast("bigint").alias("t_sum"))


def packet_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 20 + 1).cast("string")).alias("src_ip"), F.lit("10.0.1.1").alias("dst_ip"),
        (F.col("user_id") % 3).cast("int").alias("src_port"), F.lit(80).alias("dst_port"), F.lit(6).alias("protocol"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 1400 + 60).alias("size"),
        (F.col("event_id") % 32).cast("int").alias("flags"))


PACKETS = """pk AS (SELECT '10.0.0.' || (user_id % 20 + 1) AS src_ip, user_id % 3 AS src_port, epoch_us(ts) / 1e6::DOUBLE AS s, event_id % 1400 + 60 AS size, event_id % 32 AS flags, event_id FROM events),
ps AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY src_ip, src_port ORDER BY s, event_id) <= 14400 THEN 0 ELSE 1 END AS nw FROM pk),
pr AS (SELECT *, sum(nw) OVER (PARTITION BY src_ip, src_port ORDER BY s, event_id) AS run FROM ps)"""


@query("s10_packets_to_flows", with_sql(PACKETS) + " SELECT src_ip, src_port::INT AS src_port, round(min(s) * 1e6)::BIGINT AS t, count(*) AS fwd_packets, sum(size)::BIGINT AS fwd_bytes, max(size) AS fwd_len_max, count(*) FILTER (flags & 2 > 0) AS syn, round(max(s) - min(s), 4) AS seconds, round((max(s) - min(s)) / count(*), 4) AS iat_mean FROM pr GROUP BY src_ip, src_port, run")
def _(spark, sf):
    f = packets.packets_to_flows(packet_rows(spark, sf).drop("at"), 14400)
    return f.select("src_ip", "src_port", F.round(F.col("t") * 1e6).cast("bigint").alias("t"), "fwd_packets", "fwd_bytes", "fwd_len_max", "syn", r(F.col("fwd_iat") / 1e6, "seconds", 4), r(F.col("iat_mean") / 1e6, "iat_mean", 4))


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event*.parquet")


@query("s10_packet_stream")
def _(spark, sf):
    e = event_stream(spark, sf)
    p = e.select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 20 + 1).cast("string")).alias("src_ip"), F.lit("10.0.1.1").alias("dst_ip"), (F.col("user_id") % 3).cast("int").alias("src_port"),
                 F.lit(80).alias("dst_port"), F.lit(6).alias("protocol"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 1400 + 60).alias("size"), (F.col("event_id") % 32).cast("int").alias("flags"))
    out = drain(packets.packet_stream_to_flows(p, "4 hours"), spark, "packets")
    return out.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n_flows"), F.sum("fwd_packets").alias("n_packets"))


AT = datetime.datetime(2001, 1, 1)


def snapshot_table(spark, sf):
    path = new_path(spark, "snapshots")
    s = live_scored(spark, sf).withColumns({"captured_at": F.timestamp_seconds("t"), "threat_score": F.col("score")})
    tables.append_snapshots(s.where("k2 % 2 = 0").withColumn("captured_at", F.date_trunc("year", "captured_at")), path)
    tables.append_snapshots(s.where("k2 % 2 = 1").withColumn("captured_at", F.date_trunc("year", "captured_at")), path)
    return path


SNAP = "sn AS (SELECT *, date_trunc('year', make_timestamp(t * 1000000))::TIMESTAMP AS captured_at FROM ls)"


@query("s11_append_snapshots", with_sql(LIVE_SCORED, SNAP) + " SELECT captured_at::DATE::VARCHAR AS day, count(*) AS n FROM sn GROUP BY 1")
def _(spark, sf):
    return spark.read.parquet(snapshot_table(spark, sf)).groupBy(F.col("capture_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("s12_rehydrate", with_sql(LIVE_SCORED, SNAP) + f", rc AS (SELECT * FROM sn WHERE captured_at >= TIMESTAMP '1998-06-01' ORDER BY captured_at DESC, {K} LIMIT 500) SELECT src_ip, arg_min(score, ({K})) AS score FROM rc GROUP BY 1")
def _(spark, sf):
    s = spark.read.parquet(snapshot_table(spark, sf))
    seconds = int((AT - datetime.datetime(1998, 6, 1)).total_seconds())
    return tables.first_scores(tables.rehydrate(s, AT, seconds, TIE, 500), TIE)


@query("s13_retention", with_sql(LIVE_SCORED, SNAP) + " SELECT captured_at::DATE::VARCHAR AS day, count(*) AS n FROM sn WHERE captured_at >= TIMESTAMP '2001-01-01' - INTERVAL 20000 HOUR GROUP BY 1")
def _(spark, sf):
    path = snapshot_table(spark, sf)
    kept = new_path(spark, "kept")
    tables.purge_snapshots(spark, path, kept, AT, 20000)
    return spark.read.parquet(kept).groupBy(F.col("capture_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("s14_emit_results", "WITH " + windowed_sql() + " SELECT window_id, count(*) AS n FROM win GROUP BY 1")
def _(spark, sf):
    path = new_path(spark, "emit")
    tables.emit(windowed(spark, sf).groupBy("window_id").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("window_id bigint, n bigint").json(path)


@query("s14_result_sinks", "WITH " + windowed_sql() + " SELECT window_id, count(*) AS n, count(*) AS n_csv, window_id % 3 AS batch, count(*) OVER (PARTITION BY window_id % 3) AS n_rows FROM win GROUP BY window_id")
def _(spark, sf):
    """Three micro-batches as JSON, CSV and a report; one runs again, one failed before its commit."""
    source, root = new_path(spark, "window-results"), new_path(spark, "sinks")
    rows = windowed(spark, sf).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    part = lambda k: rows.where(F.col("window_id") % 3 == k)
    for k in range(3):
        part(k).coalesce(1).write.mode("append").parquet(source)
    sink = ResultSink(spark, root)
    part(2).union(part(1)).write.json(f"{root}/json/batch=0")  # what a run left that never committed
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    (stream.writeStream.foreachBatch(sink.process).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    sink.process(part(0), 1)  # the same batch id again
    json, csvs = sink.read("json", "window_id bigint, n bigint"), sink.read("csv", "window_id bigint, n_csv bigint").drop("batch")
    both = json.join(csvs, "window_id", "full").join(sink.read("report", "n_rows bigint"), "batch")
    return both.select("window_id", "n", "n_csv", "batch", "n_rows")


@query("s15_read_ledger", with_sql(LEDGER) + " SELECT incident_id AS id, tx AS tx_hash, source_ip, coalesce(gas_used, -1) AS gas_used, 'confirmed' AS status FROM led")
def _(spark, sf):
    raw = ledger(spark, sf).select(F.col("incident_id").alias("id"), F.col("tx").alias("tx_hash"), "source_ip", "attack_type", "gas_used")
    return tables.read_ledger(raw).select("id", "tx_hash", "source_ip", F.coalesce("gas_used", F.lit(-1)).alias("gas_used"), "status")


# -------------------------------------------------------------------- streams
EV = "ew AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, event_type, value FROM events)"


@query("r01_tumbling_stream", with_sql(EV) + " SELECT t // 3600 * 3600 AS window_start, count(*) AS n_flows, round(sum(value), 4) AS value FROM ew GROUP BY 1 HAVING t // 3600 * 3600 + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)".replace("HAVING t // 3600 * 3600 + 3600", "HAVING max(t) // 3600 * 3600 + 3600"))
def _(spark, sf):
    e = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("at"), "value")
    return rounded(drain(tumbling_counts(e, 3600, "10 minutes"), spark, "tumbling"), value=4)


def event_flows(spark, sf):
    return event_stream(spark, sf).select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"),
        "value", "event_id")


EVENT_SCHEMA = "t bigint, src_ip string, dst_ip string, value double, event_id bigint"


@query("r02_closed_windows", with_sql(EV) + " SELECT t // 3600 AS window_id, count(*) AS n_flows, 0::BIGINT AS over_gate, count(*) < 8 AS unscored FROM ew GROUP BY 1")
def _(spark, sf):
    root = new_path(spark, "windows")
    closer = WindowCloser(spark, root, EVENT_SCHEMA, seconds=3600, block=86400)
    run_to_end(event_flows(spark, sf), closer, f"{root}/checkpoint")
    return closer.results()


@query("r03_flush_tail", with_sql(EV) + " SELECT t // 86400 AS window_id, count(*) AS n_flows FROM ew GROUP BY 1 HAVING t // 86400 = (SELECT max(t) // 86400 FROM ew)".replace("HAVING t // 86400", "HAVING max(t) // 86400"))
def _(spark, sf):
    """The partial last window is only closed by the flush after the source ended."""
    root = new_path(spark, "windows")
    closer = WindowCloser(spark, root, EVENT_SCHEMA, seconds=86400, block=86400 * 30)
    run_to_end(event_flows(spark, sf), closer, f"{root}/checkpoint")
    tail = spark.read.parquet(f"{root}/results").where(F.col("batch") % 2 == 1)  # flushes have odd marks
    return tail.select("window_id", "n_flows")


@query("r04_late_flows", "SELECT count(*) AS n_flows FROM events")
def _(spark, sf):
    """Files arrive out of order: closed windows and late rows together are the input."""
    src, root = new_path(spark, "shuffled"), new_path(spark, "windows")
    e = table(spark, sf, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"), "value", "event_id")
    e.repartition(3, F.col("event_id") % 3).write.parquet(src)
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    closer = WindowCloser(spark, root, EVENT_SCHEMA, seconds=3600, delay=7200, block=86400)
    run_to_end(stream, closer, f"{root}/checkpoint")
    parts = closer.results().select(F.col("n_flows")).unionByName(closer.late().agg(F.count(F.lit(1)).alias("n_flows")))
    return parts.agg(F.sum("n_flows").alias("n_flows"))


@query("r05_window_scoped_gaps", with_sql(EV) + ", d AS (SELECT t // 3600 AS window_id, coalesce(t - lag(t) OVER (PARTITION BY t // 3600, user_id, event_type ORDER BY t, event_id), 86400) AS dp, coalesce(t - lag(t) OVER (PARTITION BY t // 3600, user_id ORDER BY t, event_id), 86400) AS ds FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, event_type, event_id FROM events)) SELECT window_id, sum(dp)::DOUBLE AS dt_pair, sum(ds)::DOUBLE AS dt_src FROM d GROUP BY 1")
def _(spark, sf):
    root = new_path(spark, "windows")
    score = lambda rows: rows.groupBy("window_id").agg(F.sum("dt_pair").alias("dt_pair"), F.sum("dt_src").alias("dt_src"))
    closer = WindowCloser(spark, root, EVENT_SCHEMA, score, seconds=3600, block=86400, tie=("event_id",), delta_scope="window")
    run_to_end(event_flows(spark, sf), closer, f"{root}/checkpoint")
    return closer.results()


def host_windows(spark, sf, seconds):
    """Per window and user: flows, written as a table that a stream can read."""
    path = new_path(spark, "host-windows")
    e = table(spark, sf, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "user_id")
    w = e.groupBy((F.floor(F.col("t") / seconds) * seconds + seconds).alias("window_end"), F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 100).cast("string"), F.lit("."), (F.col("user_id") % 100).cast("string")).alias("ip")).agg(F.count(F.lit(1)).alias("flows_now"))
    w.withColumn("at", F.timestamp_seconds("window_end")).write.parquet(path)
    return spark.readStream.schema("window_end bigint, ip string, flows_now bigint, at timestamp").parquet(path)


def host_episodes(seconds, ttl):
    """SQL of host windows with a number for each stretch without a silence longer than the time to live."""
    return f"""hw AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // {seconds} * {seconds} + {seconds} AS window_end, '10.0.' || user_id // 100 || '.' || user_id % 100 AS ip, count(*) AS flows_now FROM events GROUP BY 1, 2),
gap AS (SELECT *, CASE WHEN window_end - lag(window_end) OVER (PARTITION BY ip ORDER BY window_end) > {ttl} THEN 1 ELSE 0 END AS fresh FROM hw),
ep AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY window_end) AS episode FROM gap),
h AS (SELECT *, count(*) OVER before AS wb, coalesce(sum(flows_now) OVER before, 0) AS past FROM ep WINDOW before AS (PARTITION BY ip, episode ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gone AS (SELECT ip, max(window_end) + {ttl} AS window_end, count(*) AS seen, sum(flows_now) AS total FROM ep GROUP BY ip, episode HAVING max(window_end) + {ttl} < (SELECT max(window_end) - 60 FROM hw) OR episode < (SELECT max(episode) FROM ep x WHERE x.ip = ep.ip))"""


@query("r06_host_history_stream", with_sql(host_episodes(3600, 86400)) + """ SELECT ip, window_end, 'seen' AS event, wb AS windows_before, round(past / greatest(wb, 1), 6) AS mean_flows_before, round(flows_now / greatest(past / greatest(wb, 1), 1), 6) AS burst FROM h
  UNION ALL SELECT ip, window_end, 'expired', seen, round(total / seen, 6), NULL FROM gone""")
def _(spark, sf):
    """A host that is silent for a day is let go, and starts anew when it returns."""
    return rounded(drain(state.host_history_stream(host_windows(spark, sf, 3600), ttl=86400), spark, "history"))


MEMORY_ROWS = """m AS (SELECT ip, window_end, 'seen' AS event, CASE WHEN past + flows_now >= 2 THEN 'heavy' ELSE 'tail' END AS tier, past < 2 AS cold, CASE WHEN past < 2 THEN '10.0.' || split_part(ip, '.', 3) || '.0/24' ELSE ip END AS slot, (past + flows_now)::BIGINT AS flow_count, flows_now FROM h
  UNION ALL SELECT ip, window_end, 'expired', CASE WHEN total >= 2 THEN 'heavy' ELSE 'tail' END, true, '10.0.' || split_part(ip, '.', 3) || '.0/24', total::BIGINT, 0 FROM gone)"""


@query("r07_host_memory_stream", with_sql(host_episodes(600, 1800), MEMORY_ROWS) + " SELECT * FROM m")
def _(spark, sf):
    return drain(state.host_memory_stream(host_windows(spark, sf, 600), ttl=1800), spark, "memory")


SUBNET_ROWS = """cw AS (SELECT slot AS subnet, window_end, count(*) AS cold_hosts, sum(flows_now) AS cold_flows FROM m WHERE event = 'seen' AND cold GROUP BY 1, 2),
cg AS (SELECT *, CASE WHEN window_end - lag(window_end) OVER (PARTITION BY subnet ORDER BY window_end) > 1800 THEN 1 ELSE 0 END AS fresh FROM cw),
ce AS (SELECT *, sum(fresh) OVER (PARTITION BY subnet ORDER BY window_end) AS episode FROM cg),
ch AS (SELECT *, count(*) OVER before AS wb, coalesce(sum(cold_flows) OVER before, 0) AS past FROM ce WINDOW before AS (PARTITION BY subnet, episode ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cgone AS (SELECT subnet, max(window_end) + 1800 AS window_end, count(*) AS seen, sum(cold_flows) AS total FROM ce GROUP BY subnet, episode HAVING max(window_end) + 1800 < (SELECT max(window_end) - 60 FROM cw) OR episode < (SELECT max(episode) FROM ce x WHERE x.subnet = ce.subnet))"""


@query("r07_subnet_memory_stream", with_sql(host_episodes(600, 1800), MEMORY_ROWS, SUBNET_ROWS) + """ SELECT subnet, window_end, 'seen' AS event, cold_hosts, cold_flows::BIGINT AS cold_flows, wb AS windows_before, past::BIGINT AS flows_before FROM ch
  UNION ALL SELECT subnet, window_end, 'expired', 0, 0, seen, total::BIGINT FROM cgone""")
def _(spark, sf):
    """Two states in a chain: the /24 of the hosts that the first tier found cold."""
    path = new_path(spark, "memory-rows")
    first = state.host_memory_stream(host_windows(spark, sf, 600), ttl=1800)
    (first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.readStream.schema(first.schema).parquet(f"{path}/out")
    return drain(state.subnet_memory_stream(rows, ttl=1800), spark, "subnets")


def scaler_inputs(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600 + 21600).alias("window_end"), "value", F.log1p("value").alias("log_value"))
    w = state.feature_windows(e, ["value", "log_value"], "event_type")
    ref = e.agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"), F.avg("log_value").alias("c"), F.stddev_pop("log_value").alias("d"))
    rows = F.explode(F.array(F.struct(F.lit("value").alias("feature"), F.col("a").alias("ref_mean"), F.col("b").alias("ref_std")), F.struct(F.lit("log_value").alias("feature"), F.col("c").alias("ref_mean"), F.col("d").alias("ref_std"))))
    return w, ref.select(rows.alias("x")).select("x.*")


@query("r08_feature_windows", "SELECT event_type AS segment, 'value' AS feature, CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 + 21600 AS window_end, round(avg(value), 6) AS batch_mean, round(var_pop(value), 2) AS batch_var FROM events GROUP BY 1, 3")
def _(spark, sf):
    w, _ = scaler_inputs(spark, sf)
    return rounded(w.where("feature = 'value'"), batch_var=2)


@query("r08_scaler_drift")
def _(spark, sf):
    w, ref = scaler_inputs(spark, sf)
    return state.drift_report(state.scaler_batch(w, ref, half_life=86400.0, warmup=5, sigma=0.2))


@query("r08_scaler_stream")
def _(spark, sf):
    w, ref = scaler_inputs(spark, sf)
    path = new_path(spark, "scaler")
    w.write.parquet(path)
    stream = spark.readStream.schema(w.schema).parquet(path)
    return drain(state.scaler_stream(stream, ref), spark, "scaler-out")


FOLD = """e AS (SELECT event_type AS segment, event_id % 3 AS step, value AS score, event_id FROM events),
w AS (SELECT segment, step, list(score ORDER BY event_id) AS scores FROM e GROUP BY 1, 2),
f AS (SELECT DISTINCT segment, -1::BIGINT AS step, 0::DOUBLE AS threshold, 0::DOUBLE AS realised_fpr, 0.01::DOUBLE AS alpha, 0::BIGINT AS n_reference, []::DOUBLE[] AS kept FROM e
  UNION ALL SELECT segment, step, threshold, over, least(greatest(alpha + 0.01 * (0.01 - CASE WHEN over > 0.01 THEN 1 ELSE 0 END), 0.0001), 0.5), len(scores), list_concat(kept, scores)[-2000:]
  FROM (SELECT *, len(list_filter(scores, lambda x: x > threshold)) / len(scores) AS over
    FROM (SELECT f.segment, w.step, f.alpha, f.kept, w.scores,
        CASE WHEN len(f.kept) = 0 THEN 'inf'::DOUBLE ELSE list_sort(f.kept)[1 + floor((1 - f.alpha) * (len(f.kept) - 1))::BIGINT]
          + ((1 - f.alpha) * (len(f.kept) - 1) - floor((1 - f.alpha) * (len(f.kept) - 1))) * (list_sort(f.kept)[1 + ceil((1 - f.alpha) * (len(f.kept) - 1))::BIGINT] - list_sort(f.kept)[1 + floor((1 - f.alpha) * (len(f.kept) - 1))::BIGINT]) END AS threshold
      FROM f JOIN w ON w.segment = f.segment AND w.step = f.step + 1)))"""


@query("r09_adaptive_threshold", "WITH RECURSIVE " + FOLD + " SELECT segment, step, CASE WHEN isinf(threshold) THEN -1 ELSE round(threshold, 6) END AS threshold, round(realised_fpr, 6) AS realised_fpr, round(alpha, 6) AS alpha, n_reference, len(kept) AS buffered, round(list_sum(kept), 4) AS buffer_sum FROM f WHERE step >= 0")
def _(spark, sf):
    """Three micro-batches of reference scores for every event type; the state of each is what the one before left."""
    source, root = new_path(spark, "reference-scores"), new_path(spark, "thresholds")
    e = table(spark, sf, "events").select(F.col("event_type").alias("segment"), F.col("value").alias("score"), "event_id", (F.col("event_id") % 3).alias("window_id"))
    for window in range(3):
        e.where(F.col("window_id") == window).coalesce(1).write.mode("append").parquet(source)
    first = e.select("segment").distinct().select("segment", F.lit(0.01).alias("alpha"), F.array().cast("array<double>").alias("scores"))
    steps = SteppedState(spark, root, first, lambda now, rows, window: state.threshold_step(now, rows, ["event_id"]).withColumn("step", F.lit(window).cast("bigint")))
    steps.run(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return steps.reports().select(
        "segment", "step", F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.round("threshold", 6)).alias("threshold"), F.round("realised_fpr", 6).alias("realised_fpr"),
        F.round("alpha", 6).alias("alpha"), "n_reference", F.size("scores").cast("bigint").alias("buffered"), F.round(total, 4).alias("buffer_sum"))


@query("r11_enriched_stream", "SELECT event_type AS attack_class, user_id % 7 = 0 AS blocked, count(*) AS n, any_value(CASE event_type WHEN 'error' THEN 'drop' END) AS action FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = event_stream(spark, sf).select(F.col("event_type").alias("attack_class"), F.col("user_id").cast("string").alias("src_ip"))
    policy = spark.createDataFrame([("error", "drop")], "attack_class string, action string")
    b = table(spark, sf, "events").where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("ip"))
    out = drain(feeds.enrich(e, policy, blocked=b), spark, "enriched")
    return out.groupBy("attack_class", "blocked").agg(F.count(F.lit(1)).alias("n"), F.first("action").alias("action"))


@query("r12_once_per_minute", "SELECT count(DISTINCT user_id || '|' || CAST(floor(epoch(ts)) AS BIGINT) // 3600) AS n FROM events")
def _(spark, sf):
    e = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("at"), F.concat_ws("|", F.col("user_id").cast("string"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("string")).alias("key"))
    return drain(feeds.once_per_key(e, "key", "at", "90 minutes"), spark, "once").agg(F.count(F.lit(1)).alias("n"))


@query("r13_poll_refresh", BASE.replace(CFG, CFG.replace(" UNION ALL SELECT '10.0.0.200'", "")) + ", " + HOSTS + " SELECT * FROM host")
def _(spark, sf):
    src, root = new_path(spark, "live"), new_path(spark, "polls")
    rows = live(spark, sf)
    rows.write.parquet(src)
    writer = feeds.poll_writer(root, lambda: blocked(spark, sf), lambda: spark.createDataFrame([], "idempotency_key string"), ORDER, LIMITS)
    q = spark.readStream.schema(rows.schema).parquet(src).writeStream.foreachBatch(writer).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/hosts").drop("batch")


POLLS = "po AS (SELECT event_type AS source, event_id AS t, CASE WHEN event_id > 9990 AND event_type <> 'view' THEN 'failed' WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'ok_empty' ELSE 'ok' END AS status, CASE WHEN user_id % 4 = 0 THEN 'refused' ELSE 'submitted' END AS state, CAST(user_id AS BIGINT) AS n_flows FROM events)"


def polls(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), i.alias("t"),
        F.when((i > 9990) & (F.col("event_type") != "view"), "failed").when(i % 5 == 0, "failed").when(i % 3 == 0, "ok_empty").otherwise("ok").alias("status"),
        F.when(F.col("user_id") % 4 == 0, "refused").otherwise("submitted").alias("state"), F.col("user_id").alias("n_flows"))


@query("r14_source_health", with_sql(POLLS) + ", l AS (SELECT source, max(t) FILTER (status LIKE 'ok%') AS last_success FROM po GROUP BY 1) SELECT source, count(*) AS polls, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok_empty') AS ok_empty, count(*) FILTER (status = 'failed') AS failed, last_success, count(*) FILTER (status = 'failed' AND t > last_success) AS consecutive_failures FROM po JOIN l USING (source) GROUP BY source, last_success")
def _(spark, sf):
    return feeds.source_health(polls(spark, sf))


@query("r14_overall_health", with_sql(POLLS) + " SELECT CASE WHEN bool_or(status <> 'ok' AND source = 'view') THEN 'down' WHEN bool_or(status <> 'ok') THEN 'degraded' ELSE 'ok' END AS status, count(*) FILTER (status <> 'ok') AS n_not_ok FROM po")
def _(spark, sf):
    return feeds.component_health(polls(spark, sf).withColumn("required", F.col("source") == "view"))


@query("r15_refusal_episodes", with_sql(POLLS) + """, a AS (SELECT *, lead(t) OVER (PARTITION BY source ORDER BY t) AS nx, row_number() OVER (PARTITION BY source ORDER BY t) - row_number() OVER (PARTITION BY source, state ORDER BY t) AS g FROM po)
  SELECT source, min(t) AS since, max(coalesce(nx, t)) AS "until", count(*) AS polls, sum(n_flows)::BIGINT AS flows, max(coalesce(nx, t)) - min(t) AS seconds FROM a WHERE state = 'refused' GROUP BY source, g""")
def _(spark, sf):
    return feeds.refusal_episodes(polls(spark, sf))
