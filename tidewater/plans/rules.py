"""Lifecycle, replication, notification and batch queries, and the small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import rules as R
from tidewater.operators.listing import with_version_order
from tidewater.plans.registry import query
from tidewater.plans.usage import VERSIONS, versions
from tidewater.session import table

c = F.col
NOW_SQL = "TIMESTAMP '2024-01-28 00:00:00'"



def _now():
    return F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")


_ORDER = "OVER (PARTITION BY key ORDER BY mod_time DESC, version_id DESC)"
_FULL = f"""SELECT concat(bucket, '/', key) AS key, version_id, mod_time, size, delete_marker, version_id % 3 = 0 AS dev, version_id % 11 = 0 AS locked FROM ({VERSIONS})"""
_RANKED = f"SELECT *, row_number() {_ORDER} = 1 AS is_latest, lag(mod_time) {_ORDER} AS successor_time, count(*) OVER (PARTITION BY key) AS num_versions FROM ({_FULL})"

RULES = [
    R.LifecycleRule("dev", prefix="click/", tags={"env": "dev"}, days=3),
    R.LifecycleRule("big", size_gt=500_000, transition_days=2),
    R.LifecycleRule("old", prefix="view/", noncurrent_days=5),
    R.LifecycleRule("off", days=0, enabled=False),
]


def _objects(spark, d):
    v = versions(spark, d).withColumn("key", F.concat("bucket", F.lit("/"), "key"))
    return v.withColumn("tags", F.create_map(F.lit("env"), F.when(c("version_id") % 3 == 0, "dev").otherwise("prod"))).withColumn("locked", c("version_id") % 11 == 0)


def _ranked(spark, d):
    return with_version_order(_objects(spark, d), ["key"])


@query("join_lc_rules", f"SELECT key, version_id, starts_with(key, 'click/') AND dev AS dev, delete_marker OR size > 500000 AS big FROM ({_FULL})")
def _(spark, d):
    return _objects(spark, d).select("key", "version_id", R.lifecycle_matches(RULES[0]).alias("dev"), R.lifecycle_matches(RULES[1]).alias("big"))


_DUE = "date_trunc('day', {} + INTERVAL {} DAY)"
_EVENTS = f"""SELECT key, version_id, size, rule, action, due FROM (
 SELECT *, 'dev' AS rule, 'delete' AS action, {_DUE.format('mod_time', 4)} AS due FROM ({_RANKED}) WHERE starts_with(key, 'click/') AND dev AND is_latest AND NOT delete_marker
 UNION ALL SELECT *, 'big', 'transition', {_DUE.format('mod_time', 3)} FROM ({_RANKED}) WHERE (delete_marker OR size > 500000) AND is_latest AND NOT delete_marker
 UNION ALL SELECT *, 'old', 'delete_version', {_DUE.format('successor_time', 6)} FROM ({_RANKED}) WHERE starts_with(key, 'view/') AND NOT is_latest AND successor_time IS NOT NULL)
 QUALIFY row_number() OVER (PARTITION BY key, version_id ORDER BY due > {NOW_SQL}, CASE WHEN due > {NOW_SQL} THEN false ELSE action = 'transition' END, due, rule) = 1"""


def _events(spark, d):
    out = R.lifecycle_events(_ranked(spark, d), RULES, _now())
    return out.withColumn("due", c("due").cast("timestamp_ntz"))


@query("win_lc_argmin", _EVENTS)
def _(spark, d):
    return _events(spark, d)


@query(
    "agg_lc_preview",
    f"""SELECT rule, action, horizon, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, list_sort(list_distinct(list(key)))[1:3] AS examples
 FROM (SELECT *, CASE WHEN due <= {NOW_SQL} + INTERVAL 1 DAY THEN 1 WHEN due <= {NOW_SQL} + INTERVAL 7 DAY THEN 7 END AS horizon FROM ({_EVENTS})) WHERE horizon IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return R.lifecycle_preview(_events(spark, d), _now(), [1, 7])


@query("fn_expected_expiry", f"SELECT version_id, {_DUE.format('mod_time', 4)} AS due FROM ({VERSIONS})")
def _(spark, d):
    return versions(spark, d).select("version_id", R.expected_expiry(c("mod_time"), 3).cast("timestamp_ntz").alias("due"))


@query(
    "win_noncurrent_rank",
    f"""WITH RECURSIVE v AS (SELECT key, version_id, is_latest, locked, coalesce({_DUE.format('successor_time', 6)} <= {NOW_SQL}, false) AS due, row_number() {_ORDER} AS n FROM ({_RANKED})
), f AS (
  SELECT key, version_id, n, false AS deleted, CASE WHEN is_latest THEN 0 ELSE 1 END AS kept FROM v WHERE n = 1
  UNION ALL
  SELECT v.key, v.version_id, v.n, v.due AND f.kept >= 2 AND NOT v.locked, f.kept + CASE WHEN v.due AND f.kept >= 2 AND NOT v.locked THEN 0 ELSE 1 END FROM f JOIN v ON v.key = f.key AND v.n = f.n + 1
) SELECT key, version_id, deleted FROM f""",
)
def _(spark, d):
    return R.noncurrent_kept(_ranked(spark, d), 5, 2, _now())


REPLICATION = [
    R.ReplicationRule("a", "east", 1, "click/"),
    R.ReplicationRule("b", "east", 5, "", {"env": "dev", "x": "y"}),
    R.ReplicationRule("c", "west", 2, "view/"),
]


@query(
    "join_repl_rules",
    f"""SELECT key, version_id, destination, rule FROM (SELECT *, 'a' AS rule, 'east' AS destination, 1 AS p FROM ({_FULL}) WHERE starts_with(key, 'click/')
 UNION ALL SELECT *, 'b', 'east', 5 FROM ({_FULL}) WHERE dev UNION ALL SELECT *, 'c', 'west', 2 FROM ({_FULL}) WHERE starts_with(key, 'view/'))
 QUALIFY row_number() OVER (PARTITION BY key, version_id, destination ORDER BY p DESC) = 1""",
)
def _(spark, d):
    objects = _objects(spark, d).withColumn("key", F.concat_ws("#", "key", "version_id"))
    out = R.replication_targets(objects, REPLICATION)
    return out.select(F.substring_index("key", "#", 1).alias("key"), F.substring_index("key", "#", -1).cast("bigint").alias("version_id"), "destination", "rule")


QUEUES = [R.Queue("q1", ("click", "view"), "k1", ""), R.Queue("q2", ("error",), "", "9"), R.Queue("q1", ("click",), "k", "5")]


@query(
    "join_notify",
    """SELECT DISTINCT event_id, target FROM (SELECT event_id, 'q1' AS target FROM events WHERE event_type IN ('click', 'view') AND concat('k', user_id) LIKE 'k1%'
 UNION ALL SELECT event_id, 'q2' FROM events WHERE event_type = 'error' AND concat('k', user_id) LIKE '%9'
 UNION ALL SELECT event_id, 'q1' FROM events WHERE event_type = 'click' AND concat('k', user_id) LIKE 'k%5')""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", c("event_type").alias("event"), F.concat(F.lit("k"), "user_id").alias("key"))
    return R.notified(events, QUEUES).select("event_id", "target")


@query("flt_batch_expire", f"SELECT key, version_id FROM ({_FULL}) WHERE key LIKE 'click/k_' AND mod_time < {NOW_SQL} - INTERVAL 7 DAY AND dev AND size <= 900000 AND size >= 1000")
def _(spark, d):
    keep = R.expires(_now(), "click/k?", F.make_dt_interval(F.lit(7)), None, {"env": "d?v"}, None, 900_000, 1000)
    return _objects(spark, d).filter(keep).select("key", "version_id")


@query("flt_batch_rotate", f"SELECT key, version_id FROM ({_FULL}) WHERE mod_time < TIMESTAMP '2024-01-10 00:00:00' AND dev")
def _(spark, d):
    keep = R.expires(_now(), created_before=F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), tags={"env": "dev"})
    return _objects(spark, d).filter(keep).select("key", "version_id")


@query("flt_batch_push", f"SELECT key, version_id FROM ({_FULL}) WHERE mod_time <= {NOW_SQL} - INTERVAL 2 DAY AND mod_time > {NOW_SQL} - INTERVAL 20 DAY AND dev")
def _(spark, d):
    days = lambda n: F.make_dt_interval(F.lit(n))
    return _objects(spark, d).filter(R.pushes(_now(), days(2), days(20), tags={"env": "dev", "team": "x"})).select("key", "version_id")


@query("flt_batch_pull", f"SELECT key, version_id FROM ({_FULL}) WHERE NOT dev")
def _(spark, d):
    return _objects(spark, d).filter(~R.any_of("tags", {"env": "dev"})).select("key", "version_id")


@query("fn_wildcard", "SELECT p_partkey, p_name LIKE 's%ring' AS a, p_brand LIKE 'Brand#1_' AS b FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.wildcard(c("p_name"), "s*ring").alias("a"), T.wildcard(c("p_brand"), "Brand#1?").alias("b"))


_IP = "concat('10.', user_id % 4, '.', event_id % 256, '.', event_id % 7)"


@query("fn_cidr", f"SELECT event_id, starts_with({_IP}, '10.1.') AS a, starts_with({_IP}, '10.2.') AND event_id % 256 < 128 AS b FROM events")
def _(spark, d):
    ip = F.concat(F.lit("10."), (c("user_id") % 4).cast("string"), F.lit("."), (c("event_id") % 256).cast("string"), F.lit("."), (c("event_id") % 7).cast("string"))
    return table(spark, d, "events").select("event_id", T.in_cidr(ip, "10.1.0.0/16").alias("a"), T.in_cidr(F.concat(F.lit("::ffff:"), ip), "10.2.0.0/17").alias("b"))


@query("fn_humanize_bytes", "SELECT p_partkey, CAST(p_size * CASE p_partkey % 3 WHEN 0 THEN 1048576 WHEN 1 THEN 1000000 ELSE 1 END AS BIGINT) AS n FROM part")
def _(spark, d):
    unit = F.when(c("p_partkey") % 3 == 0, "MiB").when(c("p_partkey") % 3 == 1, " MB").otherwise("")
    return table(spark, d, "part").select("p_partkey", T.parse_bytes(F.concat(c("p_size").cast("string"), unit)).alias("n"))


@query("fn_duration", "SELECT p_partkey, CAST(p_size AS BIGINT) * 86400000000000 + 5400000000000 AS ns FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.parse_duration(F.concat(c("p_size").cast("string"), F.lit("d1h30m"))).alias("ns"))


@query("fn_tags", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    tags = T.parse_tags(F.concat(F.lit("name="), F.url_encode("p_name"), F.lit("&size="), c("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", tags.alias("t")).select("p_partkey", c("t")["name"].alias("name"), c("t")["size"].alias("size"))


@query("fn_size_tag", "SELECT doc_id, CASE WHEN s < 1024 THEN 'LESS_THAN_1_KiB' WHEN s < 1048576 THEN 'LESS_THAN_1_MiB' WHEN s < 10485760 THEN 'LESS_THAN_10_MiB' WHEN s < 104857600 THEN 'LESS_THAN_100_MiB' WHEN s < 1073741824 THEN 'LESS_THAN_1_GiB' ELSE 'GREATER_THAN_1_GiB' END AS tag FROM (SELECT doc_id, n_chars * n_chars AS s FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.size_tag(c("n_chars") * c("n_chars")).alias("tag"))
