"""Queries on bursts, audit entries, metrics, policies and sites, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import audit as A
from tidewater.operators import bursts as B
from tidewater.operators import metrics as M
from tidewater.operators import policy as P
from tidewater.operators import sites
from tidewater.plans.registry import query
from tidewater.session import table

c = F.col

_KIND = "CASE event_id % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'destroyed' ELSE 'overwritten' END"
_COUNTERS = f"SELECT ts, event_type AS bucket, concat('AK', user_id % 10) AS access_key, {_KIND} AS kind, user_id + 1 AS n FROM events"


def _counters(spark, d):
    k = c("event_id") % 3
    kind = F.when(k == 0, "deleted").when(k == 1, "destroyed").otherwise("overwritten")
    return table(spark, d, "events").select(
        "ts", c("event_type").alias("bucket"), F.concat(F.lit("AK"), (c("user_id") % 10).cast("string")).alias("access_key"), kind.alias("kind"), (c("user_id") + 1).alias("n")
    )


def _stamp(s):
    return F.lit(s).cast("timestamp_ntz")


_RECENT = f"""SELECT bucket, access_key, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTERS})
 WHERE date_trunc('minute', ts) > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 600 MINUTE AND date_trunc('minute', ts) <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL"""


def _recent(spark, d):
    return B.recent(_counters(spark, d), _stamp("2024-01-15 12:00:30"), 600)


@query("st_window_counts", _RECENT)
def _(spark, d):
    return _recent(spark, d)


@query("st_sliding_burst", f"SELECT date_trunc('minute', ts) - to_minutes(m) AS start, bucket, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTERS}), (SELECT unnest(range(5)) AS m) GROUP BY ALL")
def _(spark, d):
    return B.sliding(_counters(spark, d)).withColumn("start", c("start").cast("timestamp_ntz"))


_TOPS = f"SELECT bucket, kind, day(ts) - 1 AS day, max(s) AS n FROM (SELECT bucket, kind, date_trunc('hour', ts) AS ts, sum(n) AS s FROM ({_COUNTERS}) WHERE day(ts) <= 14 GROUP BY ALL) GROUP BY ALL"
_USUAL = f"SELECT bucket, kind, CAST(ceil(coalesce(list_sort(list(n))[(7 - 14) + len(list(n)) + 1], 0) * 5 / 60.0) AS BIGINT) AS usual FROM ({_TOPS}) GROUP BY 1, 2"


def _usual(spark, d):
    history = _counters(spark, d).select((F.dayofmonth("ts") - 1).alias("day"), "bucket", "kind", F.hour("ts").alias("hour"), "n").filter("day < 14")
    return B.usual(history)


@query("agg_median_baseline", _USUAL)
def _(spark, d):
    return _usual(spark, d)


@query("join_usual", f"SELECT r.bucket, r.kind, r.n, coalesce(u.usual, 0) AS usual FROM (SELECT bucket, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_RECENT}) GROUP BY 1, 2) r LEFT JOIN ({_USUAL}) u ON r.bucket = u.bucket AND r.kind = u.kind")
def _(spark, d):
    sums = _recent(spark, d).groupBy("bucket", "kind").agg(F.sum("n").alias("n"))
    return sums.join(_usual(spark, d), ["bucket", "kind"], "left").withColumn("usual", F.coalesce("usual", F.lit(0)))


_BURSTS = f"""SELECT r.bucket, r.kind, r.n, coalesce(u.usual, 0) AS usual, w.who FROM (SELECT bucket, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_RECENT}) GROUP BY 1, 2) r
 LEFT JOIN ({_USUAL}) u ON r.bucket = u.bucket AND r.kind = u.kind
 JOIN (SELECT bucket, kind, list(access_key ORDER BY n DESC, access_key)[1:3] AS who FROM ({_RECENT}) GROUP BY 1, 2) w ON r.bucket = w.bucket AND r.kind = w.kind
 WHERE r.n >= 300 AND r.n > 2 * coalesce(u.usual, 0) AND r.bucket <> 'view'"""


def _bursts(spark, d):
    return B.bucket_bursts(_recent(spark, d), _usual(spark, d), 300, 2, ("view",))


@query("st_burst_detect", _BURSTS)
def _(spark, d):
    return _bursts(spark, d)


@query("win_top3", f"SELECT bucket, access_key, kind, n FROM ({_RECENT}) QUALIFY row_number() OVER (PARTITION BY bucket, kind ORDER BY n DESC, access_key) <= 3")
def _(spark, d):
    return B.contributors(_recent(spark, d), "bucket", "kind")


@query(
    "join_cred_not_named",
    f"""SELECT access_key, kind, n, n_named FROM (SELECT r.access_key, r.kind, CAST(sum(r.n) AS BIGINT) AS n, count(DISTINCT r.bucket) AS n_named, sum(coalesce(usual, 0)) AS usual
 FROM ({_RECENT}) r LEFT JOIN ({_USUAL}) u ON r.bucket = u.bucket AND r.kind = u.kind GROUP BY 1, 2) x WHERE n_named >= 2 AND n >= 50 AND n > 0.1 * usual
 AND NOT EXISTS (SELECT 1 FROM ({_BURSTS}) b WHERE b.kind = x.kind AND list_contains(b.who, x.access_key))""",
)
def _(spark, d):
    return B.credential_bursts(_recent(spark, d), _bursts(spark, d), _usual(spark, d), 50, 0.1)


_SEEN = f"SELECT date_trunc('minute', ts) AS ts, bucket, kind, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTERS}) GROUP BY ALL"


_INCIDENTS = f"""SELECT min(ts) AS opened, max(ts) + INTERVAL 15 MINUTE AS closes, bucket, kind, max(n) AS peak, count(*) AS seen FROM (
 SELECT *, sum(cut) OVER (PARTITION BY bucket, kind ORDER BY ts) AS run FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY bucket, kind ORDER BY ts) + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS cut FROM ({_SEEN}))) GROUP BY bucket, kind, run"""


def _incidents(spark, d):
    seen = _counters(spark, d).groupBy(F.date_trunc("minute", "ts").alias("ts"), "bucket", "kind").agg(F.sum("n").alias("n"))
    return B.incidents(seen).withColumns({x: c(x).cast("timestamp_ntz") for x in ("opened", "closes")})


@query("st_incident_session", _INCIDENTS)
def _(spark, d):
    return _incidents(spark, d)


@query(
    "rpt_incidents",
    f"""SELECT bucket, kind, opened, peak, CASE WHEN closes <= TIMESTAMP '2024-01-16 12:00:00' THEN closes END AS closed FROM ({_INCIDENTS}) WHERE opened <= TIMESTAMP '2024-01-16 12:00:00'
 AND (closes > TIMESTAMP '2024-01-16 12:00:00' OR closes >= TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 5 DAY)""",
)
def _(spark, d):
    stored = B.stored(_incidents(spark, d), _stamp("2024-01-16 12:00:00"), keep_days=5)
    both = B.listed(stored).unionByName(B.listed(stored, open_only=True)).distinct()
    return both.select("bucket", "kind", "opened", "peak", "closed")


# --- audit -----------------------------------------------------------------------------------------------------------


def _entries(spark, d):
    i = c("event_id")
    name = F.when(i % 4 == 0, "PutObject").when(i % 4 == 1, "GetObject").when(i % 4 == 2, "DeleteObject").otherwise("DeleteMultipleObjects")
    code = F.when(i % 10 == 0, 403).when(i % 10 == 1, 500).otherwise(200)
    key = F.concat(F.lit("dir"), (i % 3).cast("string"), F.lit("/o"), i.cast("string"))
    api = F.struct(name.alias("name"), c("event_type").alias("bucket"), F.when(i % 4 != 3, key).alias("object"), F.when(i % 4 == 3, F.array(key, F.lit("x"))).alias("objects"), code.alias("statusCode"))
    return table(spark, d, "events").select(
        "event_id", c("ts").alias("time"), api.alias("api"), F.concat(F.lit("AK"), "user_id").alias("accessKey"), F.when(i % 2 == 0, F.concat(F.lit("u"), (c("user_id") % 5).cast("string"))).otherwise("").alias("parentUser"),
        F.create_map(F.lit("email"), F.concat(F.lit("m"), (i % 6).cast("string"))).alias("requestClaims"), F.concat(F.lit("10.0."), (c("user_id") % 3).cast("string"), F.lit(".1")).alias("remotehost"),
    )


_AUDIT = "SELECT event_id, ts AS time FROM events WHERE "


@query("flt_audit", _AUDIT + "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' AND event_type = 'click' AND event_id % 3 = 1 AND event_id % 10 = 0 AND user_id % 3 = 2 AND event_id % 4 IN (0, 2)")
def _(spark, d):
    at = A.matches(start=_stamp("2024-01-05 00:00:00"), end=_stamp("2024-01-25 00:00:00"), bucket="click", prefix="dir1/", status="denied", ip="10.0.2.")
    return _entries(spark, d).filter(at & ~c("api.name").isin("GetObject", "DeleteMultipleObjects")).select("event_id", "time")


@query("flt_audit_user", _AUDIT + "(CASE WHEN event_id % 2 = 0 THEN concat('u', user_id % 5) ELSE concat('AK', user_id) END) = 'u3' OR event_id % 6 = 4 AND false")
def _(spark, d):
    return _entries(spark, d).filter(A.matches(user="u3")).select("event_id", "time")


@query("flt_audit_kind", _AUDIT + "event_id % 4 >= 2 AND event_id % 10 = 1")
def _(spark, d):
    return _entries(spark, d).filter(A.matches(kind="delete", status="failed")).select("event_id", "time")


@query("topk_audit", "SELECT event_id, ts AS time FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC LIMIT 100")
def _(spark, d):
    return A.newest(_entries(spark, d), 100, _stamp("2024-01-20 00:00:00")).select("event_id", "time")


@query("audit_merge", "SELECT event_id, ts AS time FROM events ORDER BY ts DESC LIMIT 1000")
def _(spark, d):
    e = _entries(spark, d)
    return A.newest(A.merged(*[e.filter(c("event_id") % 3 == k) for k in range(3)]), 5000).select("event_id", "time")


# --- metrics ---------------------------------------------------------------------------------------------------------

_REQ = "SELECT *, CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 = 1 THEN 499 WHEN event_id % 10 = 2 THEN 503 ELSE 200 END AS status, value / 40 AS ttfb, event_type AS api FROM events"


def _requests(spark, d):
    n = c("event_id") % 10
    return table(spark, d, "events").withColumns({"status": F.when(n == 0, 404).when(n == 1, 499).when(n == 2, 503).otherwise(200), "ttfb": c("value") / 40, "api": c("event_type")})


@query("agg_api_stats", f"SELECT api, count(*) AS total, count(*) FILTER (WHERE status = 499) AS canceled, count(*) FILTER (WHERE status >= 400 AND status <> 499) AS errors, count(*) FILTER (WHERE status BETWEEN 400 AND 498) AS errors_4xx, count(*) FILTER (WHERE status >= 500) AS errors_5xx FROM ({_REQ}) GROUP BY 1")
def _(spark, d):
    return M.api_stats(_requests(spark, d), "api")


_HIST = f"""SELECT a.api, b.le, count(r.ttfb) AS n FROM (SELECT DISTINCT event_type AS api FROM events) a CROSS JOIN (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'inf'::DOUBLE]) AS le, unnest(['-inf'::DOUBLE, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]) AS lo) b
 LEFT JOIN ({_REQ}) r ON r.api = a.api AND r.ttfb <= b.le AND r.ttfb > b.lo GROUP BY 1, 2"""


@query("agg_ttfb_hist", _HIST)
def _(spark, d):
    return M.ttfb_histogram(_requests(spark, d))


@query("win_cumhist", f"SELECT api, le, CAST(sum(n) OVER (PARTITION BY api ORDER BY le) AS BIGINT) AS n FROM ({_HIST})")
def _(spark, d):
    return M.cumulative(M.ttfb_histogram(_requests(spark, d)))


@query("win_last60s", "SELECT event_id, CAST(sum(user_id) OVER w AS BIGINT) AS sum, round(avg(user_id) OVER w, 6) AS avg FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS e FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY e RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    out = M.last_window(table(spark, d, "events").withColumn("x", c("user_id")), "event_type", 3600)
    return out.select("event_id", "sum", F.round("avg", 6).alias("avg"))


@query("win_lasthour", "SELECT minute, event_type, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY minute RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM (SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, d):
    return M.last_hour(table(spark, d, "events"), "event_type").withColumn("minute", c("minute").cast("timestamp_ntz"))


@query(
    "win_ewma",
    """SELECT user_id, round(sum(value * pow(0.9, back) * CASE WHEN back = n - 1 THEN 1.0 ELSE 0.1 END), 6) AS ewma, count(*) AS n, max(value) AS peak
 FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""",
)
def _(spark, d):
    samples = table(spark, d, "events").select("user_id", "ts", c("event_id").alias("seq"), c("value").alias("x"))
    return M.decaying(samples, "user_id").withColumn("ewma", F.round("ewma", 6))


@query(
    "agg_queue_stats",
    """SELECT user_id, count(*) AS n, max(value) AS peak, round(avg(value), 6) AS mean, round(sum(value * pow(0.9, back) * CASE WHEN back = n - 1 THEN 1.0 ELSE 0.1 END), 6) AS ewma
 FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""",
)
def _(spark, d):
    samples = table(spark, d, "events").select("user_id", "ts", c("event_id").alias("seq"), c("value").alias("x"))
    return M.queue_stats(samples, "user_id").select("user_id", "n", "peak", F.round("mean", 6).alias("mean"), F.round("ewma", 6).alias("ewma"))


@query("agg_rt_merge", "SELECT event_type AS metric, user_id % 4 AS host, count(*) AS n, max(value) AS peak, max(ts) AS at FROM events GROUP BY ROLLUP (event_type, user_id % 4) HAVING event_type IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "events").select(c("event_type").alias("metric"), (c("user_id") % 4).alias("host"), F.lit(1).alias("n"), c("value").alias("peak"), c("ts").alias("at"))
    return M.merge_nodes(rows)


@query(
    "win_promql",
    """SELECT event_id, CAST(sum(step) OVER r AS BIGINT) AS increase, round(sum(step) OVER r / 21600, 9) AS rate, user_id - first_value(user_id) OVER s AS delta, max(user_id) OVER r AS most
 FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS e, CASE WHEN user_id < lag(user_id) OVER w THEN user_id ELSE coalesce(user_id - lag(user_id) OVER w, 0) END AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
 WINDOW r AS (PARTITION BY event_type ORDER BY e RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW), s AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    series = table(spark, d, "events").select("event_id", "ts", "event_type", c("user_id").alias("value"))
    out = M.over_time(series, "event_type", 21600)
    rate = F.round(c("rate") * 1e9) / 1e9  # in doubles like the SQL; round(x, 9) goes by the decimal text and gives other last places from about 1e5 on
    return out.select("event_id", "increase", rate.alias("rate"), "delta", c("max_over_time").alias("most"))


@query("win_predict_linear", "SELECT event_type, round(regr_intercept(value, t) + regr_slope(value, t) * (max(t) + 604800), 4) AS predicted FROM (SELECT *, e - min(e) OVER (PARTITION BY event_type) AS t FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS e FROM events)) GROUP BY 1")
def _(spark, d):
    return M.predict_linear(table(spark, d, "events"), "event_type", 604800).withColumn("predicted", F.round("predicted", 4))


# --- policies --------------------------------------------------------------------------------------------------------


def _policy_requests(spark, d):
    i = c("event_id")
    context = F.map_from_arrays(
        F.array(F.lit("SourceIp"), F.lit("prefix"), F.lit("max-keys"), F.lit("SecureTransport"), F.lit("CurrentTime"), F.lit("Empty"), F.lit("Sometimes")),
        F.array(
            F.array(F.concat(F.lit("10.0."), (c("user_id") % 4).cast("string"), F.lit(".7"))), F.array(F.concat(F.lit("p"), (i % 3).cast("string")), F.lit("zz")), F.array((i % 100).cast("string")),
            F.array((i % 2 == 0).cast("string")), F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.array().cast("array<string>"), F.when(i % 4 == 0, F.array(F.lit("x"))),
        ),
    )
    action = F.when(i % 3 == 0, "s3:GetObject").when(i % 3 == 1, "s3:PutObject").otherwise("s3:DeleteObject")
    return table(spark, d, "events").select("event_id", action.alias("action"), c("event_type").alias("bucket"), F.concat(F.lit("o"), i.cast("string")).alias("object"), F.concat(F.lit("user"), (c("user_id") % 5).cast("string")).alias("principal"), context.alias("context"))


def _conditions(*tests):
    return lambda spark, d: _policy_requests(spark, d).select("event_id", *[P.condition(c("context"), op, key, values).alias(f"t{k}") for k, (op, key, values) in enumerate(tests)])


query("cond_string", "SELECT event_id, event_id % 3 = 1 AS t0, event_id % 3 <> 1 AS t1, event_id % 3 = 2 AS t2, false AS t3, true AS t4 FROM events")(
    _conditions(("StringEquals", "s3:prefix", ("p1", "q")), ("StringNotEquals", "s3:prefix", ("p1",)), ("StringEqualsIgnoreCase", "s3:prefix", ("P2",)), ("ForAllValues:StringEquals", "s3:prefix", ("p1",)), ("ForAllValues:StringEquals", "aws:Empty", ("p1",)))
)
query("cond_like", "SELECT event_id, user_id % 4 IN (1, 2) AS t0, event_id % 3 = 2 AS t1, event_id % 3 <> 1 AS t2, event_id % 3 < 2 AS t3 FROM events")(
    _conditions(("StringLike", "aws:SourceIp", ("10.0.1.*", "*.2.7")), ("StringLike", "s3:prefix", ("?2",)), ("StringNotLike", "s3:prefix", ("?1",)), ("ForAllValues:StringLike", "s3:prefix", ("p0", "*1", "z*")))
)
query("cond_null", "SELECT event_id, event_id % 4 <> 0 AS t0, event_id % 4 = 0 AS t1, false AS t2, event_id % 2 = 0 AS t3, event_id % 2 = 1 AS t4 FROM events")(
    _conditions(("Null", "aws:Sometimes", ("true",)), ("Null", "aws:Sometimes", ("false",)), ("Bool", "aws:Nope", ("true",)), ("Bool", "aws:SecureTransport", ("true",)), ("Bool", "aws:SecureTransport", ("false",)))
)
query("cond_numeric", "SELECT event_id, event_id % 100 = 7 AS t0, event_id % 100 <= 50 AS t1, event_id % 100 > 90 AS t2, true AS t3, false AS t4 FROM events")(
    _conditions(("NumericEquals", "s3:max-keys", (7,)), ("NumericLessThanEquals", "s3:max-keys", (50,)), ("NumericGreaterThan", "s3:max-keys", (90,)), ("NumericGreaterThanIfExists", "s3:nope", (1,)), ("NumericEquals", "s3:prefix", (1,)))
)
query("cond_date", "SELECT event_id, date_trunc('second', ts) < TIMESTAMP '2024-01-10 00:00:00' AS t0, date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' AS t1, false AS t2 FROM events")(
    _conditions(("DateLessThan", "aws:CurrentTime", ("2024-01-10 00:00:00",)), ("DateGreaterThanEquals", "aws:CurrentTime", ("2024-01-10 00:00:00",)), ("DateLessThan", "aws:Nope", ("2024-01-10 00:00:00",)))
)
query("cond_lookup", "SELECT event_id, CAST(event_id % 100 AS VARCHAR) AS v FROM events")(
    lambda spark, d: _policy_requests(spark, d).select("event_id", F.get(P.lookup(c("context"), "s3:max-keys"), F.lit(0)).alias("v"))
)

STATEMENTS = [
    P.Statement("Allow", ("s3:Get*", "s3:Put*"), resources=("click/*", "view/*")),
    P.Statement("Allow", ("*",), resources=("error/o1*",), principals=("user1", "user2")),
    P.Statement("Deny", ("s3:Put*",), conditions=(("IpAddress", "aws:SourceIp", ("10.0.2.0/24",)),)),
    P.Statement("Deny", not_actions=("s3:Get*",), resources=("view/*",)),
]
_ALLOW = """((event_id % 3 < 2 AND event_type IN ('click', 'view')) OR (event_type = 'error' AND CAST(event_id AS VARCHAR) LIKE '1%' AND user_id % 5 IN (1, 2)))"""
_DENY = "((event_id % 3 = 1 AND user_id % 4 = 2) OR (event_id % 3 <> 0 AND event_type = 'view'))"


@query("join_policy", f"SELECT event_id, {_ALLOW} AND NOT {_DENY} AS allowed FROM events")
def _(spark, d):
    return _policy_requests(spark, d).select("event_id", P.allowed(STATEMENTS).alias("allowed"))


@query("join_bucket_policy", f"SELECT event_id, (user_id % 5 = 0 OR {_ALLOW}) AND NOT {_DENY} AS allowed FROM events")
def _(spark, d):
    return _policy_requests(spark, d).select("event_id", P.allowed(STATEMENTS, c("principal") == "user0").alias("allowed"))


_GRANTS = """SELECT concat('user', user_id % 20) AS holder, event_type AS action, CASE WHEN event_id % 37 = 0 THEN 'Deny' ELSE 'Allow' END AS effect, event_id % 5 <> 0 AS certain FROM events
 UNION ALL SELECT 'grp1', 'view', 'Deny', true UNION ALL SELECT '*', 'click', 'Allow', true"""
_DECIDE = """CASE WHEN bool_or(effect = 'Deny' AND certain) THEN 'denied' WHEN bool_or(effect = 'Allow' AND certain) THEN CASE WHEN bool_or(effect = 'Deny' AND NOT certain) THEN 'conditional' ELSE 'allowed' END
 WHEN bool_or(effect = 'Allow' AND NOT certain) THEN 'conditional' ELSE 'none' END"""


def _grants(spark, d):
    i, u = c("event_id"), c("user_id") % 20
    own = table(spark, d, "events").select(F.concat(F.lit("user"), u.cast("string")).alias("holder"), c("event_type").alias("action"), F.when(i % 37 == 0, "Deny").otherwise("Allow").alias("effect"), (i % 5 != 0).alias("certain"))
    more = spark.createDataFrame([("grp1", "view", "Deny", True), ("*", "click", "Allow", True)], "holder string, action string, effect string, certain boolean")
    return own.unionByName(more)


@query("fn_access_decide", f"SELECT holder AS principal, action, {_DECIDE} AS decision FROM ({_GRANTS}) GROUP BY 1, 2")
def _(spark, d):
    return P.decide(_grants(spark, d).withColumnRenamed("holder", "principal"))


@query(
    "join_access",
    f"""SELECT p.principal, g.action, {_DECIDE} AS decision FROM (SELECT DISTINCT concat('user', user_id % 20) AS principal, user_id % 20 AS n FROM events) p
 JOIN ({_GRANTS}) g ON g.holder = p.principal OR g.holder = '*' OR (g.holder = 'grp1' AND n % 2 = 1) GROUP BY 1, 2""",
)
def _(spark, d):
    people = table(spark, d, "events").select(F.concat(F.lit("user"), (c("user_id") % 20).cast("string")).alias("principal"), (c("user_id") % 20).alias("n")).distinct()
    members = people.filter("n % 2 = 1").select("principal", F.lit("grp1").alias("member_of"))
    return P.access_review(people.select("principal"), members, _grants(spark, d))


# --- sites -----------------------------------------------------------------------------------------------------------


@query("join_locks", "SELECT event_type AS resource, user_id AS uid, min(ts) AS since, count(DISTINCT event_id % 5) AS n_servers, list_sort(list_distinct(list(event_id % 5))) AS servers FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_id % 5) >= 3 ORDER BY since, 1, 2 LIMIT 10")
def _(spark, d):
    dumps = table(spark, d, "events").select((c("event_id") % 5).alias("server"), c("event_type").alias("resource"), c("user_id").alias("uid"), c("ts").alias("since"))
    return sites.merged_locks(dumps, 3)


@query(
    "join_idsync",
    """WITH cr AS (SELECT c_custkey AS credential, c_nationkey AS person FROM customer WHERE c_custkey % 2 = 0), di AS (SELECT n_nationkey AS person, n_nationkey % 3 <> 0 AS active FROM nation WHERE n_nationkey < 20),
 he AS (SELECT c_custkey AS credential FROM customer WHERE c_custkey % 5 = 0), plan AS (
 SELECT cr.credential, cr.person, CASE WHEN NOT coalesce(active, false) AND he.credential IS NULL THEN 'suspend' WHEN coalesce(active, false) AND he.credential IS NOT NULL THEN 'resume' ELSE 'keep' END AS action
 FROM cr LEFT JOIN di ON cr.person = di.person LEFT JOIN he ON cr.credential = he.credential UNION ALL SELECT credential, NULL, 'forget' FROM he WHERE credential NOT IN (SELECT credential FROM cr))
 SELECT credential, action, (SELECT count(DISTINCT person) FROM plan WHERE action = 'suspend') > 4 AS stopped FROM plan""",
)
def _(spark, d):
    people = table(spark, d, "customer").select(c("c_custkey").alias("credential"), c("c_nationkey").cast("string").alias("person"))
    directory = table(spark, d, "nation").filter("n_nationkey < 20").select(c("n_nationkey").cast("string").alias("person"), (c("n_nationkey") % 3 != 0).alias("active"))
    return sites.sync_plan(people.filter("credential % 2 = 0"), directory, people.filter("credential % 5 = 0").select("credential"), 4)


@query("join_sites", "SELECT user_id AS entity, count(DISTINCT event_type) AS n_present, count(DISTINCT event_type) = 5 AND count(DISTINCT event_id % 2) = 1 AS replicated FROM events GROUP BY 1")
def _(spark, d):
    return sites.site_status(table(spark, d, "events").select(c("event_type").alias("site"), c("user_id").alias("entity"), (c("event_id") % 2).alias("value")), 5)


@query("join_tier_known", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', 'STANDARD')")
def _(spark, d):
    known = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("STANDARD",)], "o_orderpriority string")
    return table(spark, d, "orders").join(known, "o_orderpriority", "left_semi").select("o_orderkey")


@query("out_prom", "SELECT '# HELP events_total Events by type.' AS line UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT concat('events_total{type=\"', event_type, '\"} ', count(*)) FROM events GROUP BY event_type")
def _(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return M.exposition(counts.select(F.lit("events_total").alias("name"), F.lit("Events by type.").alias("help"), F.lit("counter").alias("type"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value"))


@query("win_rank_page", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
