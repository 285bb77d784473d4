"""Round trips through the readers, writers and streams: whole tables go out and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.monitoring import _COUNTERS, _INCIDENTS, _counters
from tidewater.plans.registry import query
from tidewater.session import table
from tidewater.sources import files, sinks
from tidewater.storage import fresh_path
from tidewater.streaming import streams

c = F.col


def _csv(spark, d, sep=",", header=True):
    path = fresh_path(spark, "csv")
    table(spark, d, "customer").write.option("header", header).option("sep", sep).csv(path)
    return path


_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS {0}, c_name AS {1}, c_mktsegment AS {2} FROM customer"


@query("src_csv_header", _CUSTOMER.format("c_custkey", "c_name", "c_mktsegment"))
def _(spark, d):
    return files.read_csv(spark, _csv(spark, d), comment="").select("c_custkey", "c_name", "c_mktsegment")


@query("src_csv_none", _CUSTOMER.format("_1", "_2", "_5"))
def _(spark, d):
    return files.read_csv(spark, _csv(spark, d, header=False), "NONE", comment="").select("_1", "_2", "_5")


@query("src_csv_delims", _CUSTOMER.format("c_custkey", "c_name", "c_mktsegment"))
def _(spark, d):
    return files.read_csv(spark, _csv(spark, d, "|"), sep="|", comment="").select("c_custkey", "c_name", "c_mktsegment")


@query("src_csv_record_end", "SELECT CAST(n_nationkey AS VARCHAR) AS \"the,key\", n_name AS n_name FROM nation UNION ALL SELECT 'the,key', 'n_name'")
def _(spark, d):
    path = fresh_path(spark, "csv")
    head = spark.createDataFrame([("the,key", "n_name")], "n_nationkey string, n_name string")
    rows = table(spark, d, "nation").select(c("n_nationkey").cast("string"), "n_name")
    rows = rows.withColumn("o", F.lit(1)).unionByName(head.withColumn("o", F.lit(0))).unionByName(head.withColumn("o", F.lit(2)))  # one row equals the header
    rows.coalesce(1).sortWithinPartitions("o").select(sinks.csv_line(c("n_nationkey"), c("n_name"))).write.option("lineSep", ":::").text(path)
    return files.read_csv(spark, path, "USE", record=":::")


@query("src_csv_lazy", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def _(spark, d):
    path = fresh_path(spark, "csv")
    table(spark, d, "documents").select("doc_id", "text").write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path, comment="", lazy=True)


@query("src_csv_utf8", "SELECT true AS valid UNION ALL SELECT true")
def _(spark, d):
    one = fresh_path(spark, "csv")
    table(spark, d, "nation").limit(1).select(F.concat(F.lit("x"), F.repeat(F.lit("é"), 80_000))).coalesce(1).write.text(one)  # the block ends in a character
    whole = files.invalid_text(spark, _csv(spark, d)).agg(F.bool_and("valid").alias("valid"))
    return whole.unionByName(files.invalid_text(spark, one).agg(F.bool_and("valid").alias("valid")))


def _json(spark, d):
    path = fresh_path(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return path


_EVENT = "SELECT event_id, event_type, value FROM events"


@query("src_json_lines", f"{_EVENT} UNION ALL {_EVENT}")
def _(spark, d):
    by_line = files.read_json(spark, _json(spark, d))
    path = fresh_path(spark, "json")
    odd = F.to_json(F.struct("event_id", "event_type", "value"))
    odd = F.concat(F.regexp_replace(odd, ",", ",\n "), F.when(c("event_id") % 2 == 0, " ").otherwise("\n\n"))
    table(spark, d, "events").select(odd).write.option("lineSep", " ").text(path)
    v = by_line.unionByName(files.read_json(spark, path, separated=True))
    get = lambda p, t: F.variant_get("value", p, t).alias(p[2:])
    return v.select(get("$.event_id", "bigint"), get("$.event_type", "string"), get("$.value", "double"))


@query("src_json_doc", "SELECT event_id, user_id FROM events")
def _(spark, d):
    path = fresh_path(spark, "json")
    numbered = table(spark, d, "events").groupBy(F.floor(c("event_id") / 1000).alias("g")).agg(F.collect_list(F.struct("event_id", "user_id")).alias("items"))
    numbered.select(F.to_json(F.struct("items")).alias("value"), "g").write.partitionBy("g").text(path)  # an object for each thousand events
    items = files.read_json(spark, f"{path}/*", document=True).select(F.explode(F.variant_get("value", "$.items", "array<struct<event_id:bigint,user_id:bigint>>")).alias("x"))
    return items.select("x.event_id", "x.user_id")


@query("src_json_scalar", "SELECT CAST(user_id AS BIGINT) AS _1, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path = fresh_path(spark, "json")
    table(spark, d, "events").select(c("user_id").cast("string")).write.text(path)
    values = files.as_records(files.read_json(spark, path))
    return values.groupBy(F.variant_get("value", "$._1", "bigint").alias("_1")).agg(F.count("*").alias("n"))


@query("src_parquet", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'")
def _(spark, d):
    df = files.read_parquet(spark, f"{d}/lineitem.parquet")
    return df.filter(c("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_shipdate")


@query("src_compress", "SELECT concat(codec, c_name) AS line FROM customer, (VALUES ('gz'), ('bz2'), ('txt')) t(codec)")
def _(spark, d):
    path, names = fresh_path(spark, "compressed"), table(spark, d, "customer").select("c_name")
    for codec, name in (("gzip", "gz"), ("bzip2", "bz2"), ("none", "txt")):
        names.select(F.concat(F.lit(name), "c_name")).write.option("compression", codec).text(f"{path}/{name}")
    return files.read_compressed(spark, path).filter("error IS NULL").select("line")


@query("src_scanrange", "SELECT n_name AS line FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT concat(chr(65533), 'lan') UNION ALL SELECT concat('été', n_nationkey) FROM nation WHERE n_nationkey > 0")
def _(spark, d):
    path, nation = fresh_path(spark, "range"), table(spark, d, "nation").orderBy("n_nationkey")
    nation.select("n_name").coalesce(1).write.text(f"{path}/a")
    first = F.when(c("n_nationkey") == 0, "élan").otherwise(F.concat(F.lit("été"), "n_nationkey"))
    nation.select(first).coalesce(1).write.text(f"{path}/b")
    tail = files.scan_range(spark, f"{path}/a", 10 * len("NATION_0\n"), None, piece=40)
    return tail.unionByName(files.scan_range(spark, f"{path}/b", 1, None))  # begins inside a character


def _archive(spark, d, kind):
    path = fresh_path(spark, kind)
    members = table(spark, d, "nation").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".txt")).alias("member"), c("n_name").alias("content"))
    sinks.write_archives(members.repartition(2), path, kind).count()
    return path


_MEMBERS = "SELECT concat('n/', n_nationkey, '.txt') AS member, {0} FROM nation"


@query("src_zip_member", _MEMBERS.format("n_name AS content") + " WHERE n_nationkey = 1 OR n_nationkey BETWEEN 10 AND 19")
def _(spark, d):
    return files.archive_members(spark, _archive(spark, d, "zip"), "n/1").select("member", F.decode("content", "UTF-8").alias("content"))


@query("src_snowball", _MEMBERS.format("n_name AS content"))
def _(spark, d):
    return files.archive_members(spark, _archive(spark, d, "tar")).select("member", F.decode("content", "UTF-8").alias("content"))


@query("list_zip", _MEMBERS.format("CAST(length(n_name) AS BIGINT) AS size"))
def _(spark, d):
    return files.list_archive(spark, _archive(spark, d, "zip"), "n/").select("member", "size")


@query("src_audit", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def _(spark, d):
    path = fresh_path(spark, "audit")
    rows = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    rows.repartition("day").write.partitionBy("day").option("compression", "gzip").json(path)
    return files.read_audit(spark, path, "event_id bigint, event_type string", "2024-01-10", "2024-01-12").select("event_id", "day")


@query("out_csv", """SELECT doc_id, concat(doc_id, ',', CASE WHEN regexp_matches(text, '[,"\\n\\r]') OR text LIKE ' %' THEN concat('"', replace(text, '"', '""'), '"') ELSE text END) AS line FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", sinks.csv_line(c("doc_id"), c("text")).alias("line"))


@query("out_csv_always", """SELECT p_partkey, concat('"', p_partkey, '";"', p_name, '"') AS line FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.csv_line(c("p_partkey"), c("p_name"), sep=";", always=True).alias("line"))


@query("out_json", """SELECT p_partkey, concat('{"name":"', p_name, '","size":', p_size, '}') AS line FROM part""")
def _(spark, d):
    line = sinks.json_line(name=sinks.json_text(c("p_name")), size=sinks.float_json(c("p_size").cast("double")))
    return table(spark, d, "part").select("p_partkey", sinks.guarded(line).alias("line"))


@query("out_float_json", """SELECT event_id, user_id AS id, CASE WHEN event_id % 11 = 3 THEN 'null' WHEN event_id % 11 = 4 THEN 'null' WHEN event_id % 2 = 0 THEN concat(user_id + 1, '00000000000')
 ELSE concat('0.0', CASE WHEN user_id % 10 = 0 THEN '5' ELSE concat(user_id % 10, '5') END) END AS x FROM events""")
def _(spark, d):
    u, k = c("user_id"), c("event_id") % 11
    x = F.when(k == 3, float("nan")).when(k == 4, float("-inf")).when(c("event_id") % 2 == 0, (u + 1) * 1e11).otherwise(F.when(u % 10 == 0, 0.05).otherwise((u % 10 * 10 + 5) / F.lit(1000.0)))
    return table(spark, d, "events").select("event_id", u.alias("id"), sinks.float_json(x).alias("x"))


@query("out_float_g", "SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN 'NaN' WHEN 4 THEN '+Inf' WHEN 5 THEN '-Inf' ELSE concat(p_size % 9 + 1, 'e+', CASE WHEN p_partkey % 2 = 0 THEN '07' ELSE '12' END) END AS x FROM part")
def _(spark, d):
    k = c("p_partkey") % 7
    power = F.when(c("p_partkey") % 2 == 0, 1e7).otherwise(1e12)
    x = F.when(k == 3, float("nan")).when(k == 4, float("inf")).when(k == 5, float("-inf")).otherwise((c("p_size") % 9 + 1) * power)
    return table(spark, d, "part").select("p_partkey", sinks.float_g(x).alias("x"))


_LINE = "octet_length(encode(concat(p_partkey, ',', p_name))) + 1"


@query(
    "out_eventstream",
    f"""SELECT 'Records' AS type, CAST(sum(CASE WHEN p_size > 10 THEN {_LINE} ELSE 0 END) AS BIGINT) AS bytes, NULL AS payload FROM part UNION ALL SELECT 'End', 0, ''
 UNION ALL SELECT 'Stats', length(x), x FROM (SELECT concat('<?xml version="1.0" encoding="UTF-8"?><Stats><BytesScanned>', sum({_LINE}), '</BytesScanned><BytesProcessed>', sum({_LINE}),
 '</BytesProcessed><BytesReturned>', sum(CASE WHEN p_size > 10 THEN {_LINE} ELSE 0 END), '</BytesReturned></Stats>') AS x FROM part)""",
)
def _(spark, d):
    rows = table(spark, d, "part").select(sinks.csv_line(c("p_partkey"), c("p_name")).alias("line"), (c("p_size") > 10).alias("kept"))
    size = F.octet_length("line") + 1
    closing = sinks.closing_frames(sinks.stats(rows, size, size, F.when(c("kept"), size).otherwise(0)))
    parts = sinks.parse_frames(sinks.event_stream(rows.filter("kept"), 4096).select("message").unionByName(closing))
    shown = F.when(c("type") != "Records", F.decode("payload", "UTF-8"))
    return parts.select("type", F.octet_length("payload").cast("bigint").alias("bytes"), shown.alias("payload")).groupBy("type").agg(F.sum("bytes").alias("bytes"), F.max("payload").alias("payload"))


@query("out_stats", "SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_scanned, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_processed, CAST(sum(CASE WHEN lang = 'fr' THEN octet_length(encode(text)) ELSE 0 END) AS BIGINT) AS bytes_returned FROM documents")
def _(spark, d):
    size = F.octet_length("text")
    return sinks.stats(table(spark, d, "documents"), size, size, F.when(c("lang") == "fr", size).otherwise(0))


@query("out_maxrecord", "SELECT doc_id, length(text) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length(sinks.guarded(c("text"))).cast("bigint").alias("n"))


@query("out_notify_log", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path = fresh_path(spark, "log")
    events = table(spark, d, "events").select("event_id", "event_type")
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        sinks.append_log(part, path)
    return spark.read.parquet(path)


@query("out_report_csv", "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(spark, d):
    path = fresh_path(spark, "report")
    sinks.export_csv(table(spark, d, "nation").select("n_name", "n_regionkey"), path)
    return files.read_csv(spark, path, comment="")


# --- streams ---------------------------------------------------------------------------------------------------------


def _plain(df, *stamps):
    return df.withColumns({x: c(x).cast("timestamp_ntz") for x in stamps})


def _closed(spark, rows):
    """A stream of the rows, then of one a month behind the last: it moves the watermark over all of them, and its own window stays open."""
    last = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", c("ts") + F.expr("INTERVAL 31 DAYS"))
    return streams.stream(spark, rows.unionByName(last))


def _timed(spark, d):
    return _counters(spark, d).withColumn("ts", c("ts").cast("timestamp"))


@query("st_minute_slots", f"SELECT date_trunc('minute', ts) AS minute, bucket, access_key, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTERS}) GROUP BY ALL")
def _(spark, d):
    return _plain(streams.run_once(streams.minute_slots(_closed(spark, _timed(spark, d))), "minutes"), "minute")


@query("st_sliding_stream", f"SELECT date_trunc('minute', ts) - to_minutes(m) AS start, bucket, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTERS}), (SELECT unnest(range(5)) AS m) GROUP BY ALL")
def _(spark, d):
    return _plain(streams.run_once(streams.sliding_bursts(_closed(spark, _timed(spark, d))), "sliding"), "start")


@query("st_session_stream", _INCIDENTS)
def _(spark, d):
    seen = _counters(spark, d).groupBy(F.date_trunc("minute", "ts").cast("timestamp").alias("ts"), "bucket", "kind").agg(F.sum("n").alias("n"))
    return _plain(streams.run_once(streams.incident_sessions(_closed(spark, seen)), "sessions"), "opened", "closes")


@query("st_trace", "SELECT event_id, event_type AS type, value FROM events WHERE event_type IN ('click', 'error') AND value >= 20 AND event_id % 5 = 0")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", c("event_type").alias("type"), "value")
    return streams.run_once(streams.trace(streams.stream(spark, events), ["click", "error"], 20, True, c("event_id") % 5 == 0), "trace")


@query("st_listen", "SELECT event_id, event_type AS event, concat('k', user_id) AS key FROM events WHERE event_type = 'click' AND concat('k', user_id) LIKE 'k1%' AND concat('k', user_id) LIKE '%5'")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", c("event_type").alias("event"), F.concat(F.lit("k"), "user_id").alias("key"))
    return streams.run_once(streams.listen(streams.stream(spark, events), "k1", "5", ["click"]), "listen")


@query("st_usage_delta", "SELECT CAST(ts AS DATE) AS day, event_type AS bucket, CAST(sum(user_id) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    path = fresh_path(spark, "deltas")
    deltas = table(spark, d, "events").select(F.to_date("ts").alias("day"), c("event_type").alias("bucket"), c("user_id").alias("n"))
    streams.each_batch(streams.stream(spark, deltas), lambda rows, i: streams.add_usage(rows, path, i), "usage")
    return streams.usage_totals(spark, path)
