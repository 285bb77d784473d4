"""Usage, compliance and chargeback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import usage as U
from tidewater.plans.registry import query
from tidewater.session import table

c = F.col

#: Events as object versions.
VERSIONS = """SELECT event_type AS bucket, concat('k', user_id) AS key, event_id AS version_id, ts AS mod_time, CAST(floor(value * 10000) AS BIGINT) AS size,
 event_id % 17 = 0 AS delete_marker FROM events"""


def versions(spark, d):
    return table(spark, d, "events").select(
        c("event_type").alias("bucket"), F.concat(F.lit("k"), "user_id").alias("key"), c("event_id").alias("version_id"), c("ts").alias("mod_time"),
        F.floor(c("value") * 10000).cast("bigint").alias("size"), (c("event_id") % 17 == 0).alias("delete_marker"),
    )


def _bins(bins, x):
    return ", ".join(f'count(*) FILTER (WHERE {x} >= {low}{"" if high is None else f" AND {x} < {high}"}) AS "{n}"' for n, low, high in bins)


@query("agg_hist_size", f'SELECT source AS bucket, {_bins(U.SIZE_BINS, "s")}, count(*) FILTER (WHERE s >= 1024 AND s < 1048576) AS "{U.SIZE_SUM_BIN}" FROM (SELECT *, n_chars * n_chars AS s FROM documents) GROUP BY 1')
def _(spark, d):
    return U.size_histogram(table(spark, d, "documents").select(c("source").alias("bucket"), (c("n_chars") * c("n_chars")).alias("size")))


@query("agg_hist_versions", f"SELECT bucket, {_bins(U.VERSION_BINS, 'n')} FROM (SELECT bucket, key, count(*) AS n FROM ({VERSIONS}) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return U.version_histogram(versions(spark, d))


_USAGE = f"""SELECT bucket, count(DISTINCT key) AS objects, count(*) FILTER (WHERE NOT delete_marker) AS versions, count(*) FILTER (WHERE delete_marker) AS delete_markers,
 CAST(coalesce(sum(size) FILTER (WHERE NOT delete_marker), 0) AS BIGINT) AS size FROM ({VERSIONS}) GROUP BY 1"""


@query("agg_usage_bucket", _USAGE)
def _(spark, d):
    return U.bucket_usage(versions(spark, d))


@query("agg_usage_total", f"SELECT count(*) AS n, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in ('objects', 'versions', 'delete_markers', 'size'))} FROM ({_USAGE})")
def _(spark, d):
    return U.total_usage(U.bucket_usage(versions(spark, d)))


_TIERED = f"""SELECT *, CASE version_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'WARM' WHEN 2 THEN 'COLD' ELSE 'GONE' END AS tier,
 row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC) = 1 AS is_latest FROM ({VERSIONS})"""


@query(
    "agg_tier",
    f"""SELECT t.tier, count(v.key) AS versions, CAST(coalesce(sum(size), 0) AS BIGINT) AS size, count(*) FILTER (WHERE is_latest) AS objects
 FROM (VALUES ('STANDARD'), ('WARM'), ('COLD'), ('IDLE')) t(tier) LEFT JOIN (SELECT *, coalesce(tier, 'STANDARD') AS tt FROM ({_TIERED})) v ON t.tier = v.tt GROUP BY 1""",
)
def _(spark, d):
    from tidewater.operators.listing import with_version_order

    n = c("version_id") % 4
    tiered = with_version_order(versions(spark, d), ["bucket", "key"]).withColumn("tier", F.when(n == 1, "WARM").when(n == 2, "COLD").when(n == 3, "GONE"))
    return U.tier_usage(tiered, ["STANDARD", "WARM", "COLD", "IDLE"])


_LOCKED = f"""SELECT *, CASE version_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'S3' WHEN 2 THEN 'KMS' ELSE 'C' END AS sse,
 CASE version_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'COMPLIANCE' ELSE 'governance' END AS lock_mode, mod_time + INTERVAL 10 DAY AS retain_until,
 CASE WHEN version_id % 5 = 0 THEN 'ON' ELSE 'OFF' END AS legal_hold FROM ({VERSIONS})"""


def _locked(spark, d):
    i = c("version_id")
    return versions(spark, d).withColumns(
        {
            "sse": F.when(i % 4 == 1, "S3").when(i % 4 == 2, "KMS").when(i % 4 == 3, "C"),
            "lock_mode": F.when(i % 3 == 1, "COMPLIANCE").when(i % 3 == 2, "governance"),
            "retain_until": c("mod_time") + F.expr("INTERVAL 10 DAYS"),
            "legal_hold": F.when(i % 5 == 0, "ON").otherwise("OFF"),
        }
    )


def _counts(name, test):
    return f"count(*) FILTER (WHERE {test}) AS {name}_count, CAST(coalesce(sum(size) FILTER (WHERE {test}), 0) AS BIGINT) AS {name}_bytes"


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_HELD = f"lock_mode IS NOT NULL AND retain_until > {_NOW}"
_COMPLIANCE = f"""SELECT bucket, {_counts("plain", "sse IS NULL")}, {_counts("sse_s3", "sse = 'S3'")}, {_counts("sse_kms", "sse = 'KMS'")}, {_counts("sse_c", "sse = 'C'")},
 {_counts("compliance", _HELD + " AND upper(lock_mode) = 'COMPLIANCE'")}, {_counts("governance", _HELD + " AND upper(lock_mode) = 'GOVERNANCE'")},
 {_counts("legal_hold", "legal_hold = 'ON'")}, max(CASE WHEN {_HELD} THEN retain_until END) AS latest_until FROM ({_LOCKED}) WHERE NOT delete_marker GROUP BY 1"""


@query("agg_compliance", _COMPLIANCE)
def _(spark, d):
    return U.compliance_counts(_locked(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


_CONFIG = "(VALUES ('click', 'Enabled', true, 'SSE-S3'), ('view', NULL, false, NULL), ('empty', 'Suspended', NULL, 'SSE-KMS')) b(bucket, versioning, locked, encryption)"


@query(
    "rpt_compliance",
    f"""SELECT b.bucket, coalesce(versioning, 'Off') AS versioning, coalesce(locked, false) AS locked, coalesce(encryption, 'none') AS encryption, b.bucket = 'click' AS lifecycle_expires, x.plain_count, x.compliance_count
 FROM {_CONFIG} LEFT JOIN ({_COMPLIANCE}) x ON b.bucket = x.bucket""",
)
def _(spark, d):
    config = spark.createDataFrame([("click", "Enabled", True, "SSE-S3"), ("view", None, False, None), ("empty", "Suspended", None, "SSE-KMS")], "bucket string, versioning string, locked boolean, encryption string")
    lifecycle = spark.createDataFrame([("click", True, True), ("click", True, False), ("view", False, True)], "bucket string, enabled boolean, expires boolean")
    counts = U.compliance_counts(_locked(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    out = U.compliance_report(config, counts, lifecycle)
    return out.select("bucket", "versioning", "locked", "encryption", "lifecycle_expires", "plain_count", "compliance_count")


_DAYS = "SELECT CAST(ts AS DATE) AS day, event_type AS bucket, avg(value) AS avg, max(value) AS peak, arg_max(value, ts) AS last, count(*) AS n FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1, 2"


def _days(spark, d):
    samples = table(spark, d, "events").filter(F.dayofmonth("ts") % 3 != 0).select("ts", c("event_type").alias("bucket"), c("value").alias("bytes"))
    return U.running_day(samples)


@query("agg_running_mean", _DAYS.replace("avg(value) AS avg", "round(avg(value), 6) AS avg").replace("WHERE day(ts) % 3 <> 0", ""))
def _(spark, d):
    samples = table(spark, d, "events").select("ts", c("event_type").alias("bucket"), c("value").alias("bytes"))
    return U.running_day(samples).withColumn("avg", F.round("avg", 6))


_SPINE = f"""SELECT s.day, x.bucket, CASE WHEN s.day = s.source THEN x.avg ELSE x.last END AS bytes, s.day <> s.source AS carried, CASE WHEN s.day = s.source THEN x.peak END AS peak
 FROM (SELECT g.day, (SELECT max(day) FROM ({_DAYS}) r WHERE r.day <= g.day) AS source FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) g) s
 JOIN ({_DAYS}) x ON x.day = s.source"""


@query("join_locf", f"SELECT day, bucket, round(bytes, 6) AS bytes, carried, peak FROM ({_SPINE})")
def _(spark, d):
    return U.storage_by_day(_days(spark, d), "2024-01-01", "2024-02-05").withColumn("bytes", F.round("bytes", 6))


_GB = f"SELECT bucket, sum(bytes * 1e9 / day(last_day(day)) / 1e9) AS gb_months, max(peak) AS peak FROM ({_SPINE}) GROUP BY 1"


def _by_day(spark, d):
    return U.storage_by_day(_days(spark, d), "2024-01-01", "2024-02-05").withColumn("bytes", c("bytes") * 1e9)


@query("win_daily_rollup", f"SELECT bucket, round(gb_months, 4) AS gb_months, peak FROM ({_GB})")
def _(spark, d):
    return U.gb_months(_by_day(spark, d)).withColumn("gb_months", F.round("gb_months", 4))


_KIND = "CASE WHEN event_type IN ('error', 'purchase') THEN 'write' WHEN event_type = 'signup' THEN 'delete' ELSE 'read' END"
_TRAFFIC = "SELECT CASE event_type WHEN 'view' THEN 'moved' ELSE event_type END AS bucket, CAST(sum(user_id) AS BIGINT) AS data_in, CAST(sum(event_id) AS BIGINT) AS data_out, count(*) AS read, count(*) FILTER (WHERE event_id % 2 = 0) AS write, count(*) FILTER (WHERE event_id % 10 = 0) AS delete FROM events GROUP BY 1"


def _traffic(spark, d):
    one = lambda t: F.when(t, 1).otherwise(0)
    i = c("event_id")
    return table(spark, d, "events").select(
        F.when(c("event_type") == "view", "moved").otherwise(c("event_type")).alias("bucket"), c("user_id").alias("data_in"), i.alias("data_out"), F.lit(1).alias("read"), one(i % 2 == 0).alias("write"), one(i % 10 == 0).alias("delete")
    )


_REPORT = f"""SELECT coalesce(s.bucket, t.bucket) AS bucket, coalesce(gb_months, 0) AS gb_months, peak, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('data_in', 'data_out', 'read', 'write', 'delete'))}
 FROM ({_GB}) s FULL JOIN ({_TRAFFIC}) t ON s.bucket = t.bucket"""


@query("join_storage_traffic", f"SELECT * REPLACE (round(gb_months, 4) AS gb_months) FROM ({_REPORT})")
def _(spark, d):
    return U.usage_report(_by_day(spark, d), _traffic(spark, d)).withColumn("gb_months", F.round("gb_months", 4))


@query("fn_cost", f"SELECT bucket, round(gb_months * 0.023 + data_out / 1e9 * 0.09 + write / 1e4 * 0.05, 6) AS cost FROM ({_REPORT})")
def _(spark, d):
    rates = {"storageGbMonth": 0.023, "outGb": 0.09, "per10kWrite": 0.05}
    return U.cost(U.usage_report(_by_day(spark, d), _traffic(spark, d)), rates).select("bucket", F.round("cost", 6).alias("cost"))


_APIS = "SELECT conv_id, turn, concat(CASE (conv_id + turn) % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'put' WHEN 2 THEN 'delete' WHEN 3 THEN 'list' WHEN 4 THEN 'complete' ELSE 'new' END, role) AS api FROM conversations"


def _apis(spark, d):
    n = (c("conv_id") + c("turn")) % 6
    verb = F.when(n == 0, "get").when(n == 1, "put").when(n == 2, "delete").when(n == 3, "list").when(n == 4, "complete").otherwise("new")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(verb, "role").alias("api"))


@query("join_api_kind", f"SELECT conv_id, turn, CASE WHEN api LIKE 'delete%' THEN 'delete' WHEN regexp_matches(api, '^(put|post|copy|new|complete|abort|reset)') THEN 'write' ELSE 'read' END AS kind FROM ({_APIS})")
def _(spark, d):
    return _apis(spark, d).select("conv_id", "turn", U.api_kind(c("api")).alias("kind"))


@query("agg_traffic_merge", "SELECT CAST(ts AS DATE) AS day, event_type AS bucket, list_transform(range(24), lambda h: len(list_filter(list(hour(ts)), lambda x: x = h))) AS hours FROM events GROUP BY 1, 2")
def _(spark, d):
    return U.merge_traffic(table(spark, d, "events").select(F.to_date("ts").alias("day"), c("event_type").alias("bucket"), F.hour("ts").alias("hour"), F.lit(1).alias("n")))


_TEAMS = "(VALUES ('ops', 'Brand#1'), ('web', 'Brand#1'), ('web', 'Brand#7')) x(name, bucket)"
_PREFIXES = "(VALUES ('data', 'Brand#'), ('two', 'Brand#2'), ('twos', 'Brand#2')) p(name, prefix)"


def _teams(spark):
    rows = [("ops", ["Brand#1"], []), ("web", ["Brand#1", "Brand#7"], []), ("data", [], ["Brand#"]), ("two", [], ["Brand#2"]), ("twos", [], ["Brand#2"])]
    return spark.createDataFrame(rows, "name string, members array<string>, prefixes array<string>")


@query("join_team_exact", f"SELECT b.bucket, e.name AS team, coalesce(e.n > 1, false) AS named_by_two FROM (SELECT DISTINCT p_brand AS bucket FROM part) b LEFT JOIN (SELECT bucket, min(name) AS name, count(*) AS n FROM {_TEAMS} GROUP BY 1) e ON b.bucket = e.bucket")
def _(spark, d):
    names = table(spark, d, "part").select(c("p_brand").alias("bucket")).distinct()
    return U.with_team(names, _teams(spark).withColumn("prefixes", F.array().cast("array<string>")))


@query(
    "join_team_prefix",
    f"""SELECT b.bucket, coalesce(e.name, p.name) AS team, coalesce(e.n > 1, false) AS named_by_two FROM (SELECT DISTINCT p_brand AS bucket FROM part) b
 LEFT JOIN (SELECT bucket, min(name) AS name, count(*) AS n FROM {_TEAMS} GROUP BY 1) e ON b.bucket = e.bucket
 LEFT JOIN (SELECT bucket, name FROM (SELECT DISTINCT p_brand AS bucket FROM part) q JOIN {_PREFIXES} ON starts_with(q.bucket, p.prefix)
            QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY length(prefix) DESC, name) = 1) p ON b.bucket = p.bucket""",
)
def _(spark, d):
    return U.with_team(table(spark, d, "part").select(c("p_brand").alias("bucket")).distinct(), _teams(spark))


@query("fn_quota", "SELECT p_partkey, p_size >= 45 OR (p_retailprice > 0 AND p_retailprice + p_size >= 1000) AS over FROM part")
def _(spark, d):
    over = (c("p_size") >= 45) | U.quota_exceeded(c("p_retailprice"), c("p_size"), F.lit(1000))
    return table(spark, d, "part").select("p_partkey", over.alias("over"))


@query(
    "flt_retention",
    "SELECT * FROM (SELECT day, bytes, CAST(sum(bytes) OVER (ORDER BY day DESC) AS BIGINT) AS running FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS bytes FROM events GROUP BY 1) WHERE date_diff('day', day, DATE '2024-01-31') <= 25) WHERE running <= 5000",
)
def _(spark, d):
    segments = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("bytes"))
    return U.kept_segments(segments, "2024-01-31", 25, 5000)


@query(
    "fn_day",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(ts AS DATE) END AS day, CASE WHEN event_id % 5 > 1 THEN CAST(ts AS DATE) >= DATE '2024-01-31' - 19 END AS kept FROM events""",
)
def _(spark, d):
    k, day = c("event_id") % 5, F.date_format("ts", "yyyy-MM-dd")
    text = F.when(k == 0, F.date_format("ts", "yyyy-M-d '?'")).when(k == 1, F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-32"))).otherwise(day)
    found = U.parse_day(text)
    return table(spark, d, "events").select("event_id", found.alias("day"), (found >= U.retained_since(F.lit("2024-01-31").cast("date"), 20)).alias("kept"))


@query("sort_report", f"SELECT bucket, size FROM ({_USAGE}) ORDER BY bucket")
def _(spark, d):
    return U.bucket_usage(versions(spark, d)).select("bucket", "size").orderBy("bucket")
