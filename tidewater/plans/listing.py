"""Listing and version-order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import listing as L
from tidewater.plans.registry import query
from tidewater.plans.usage import VERSIONS, versions
from tidewater.session import table

c = F.col


def _pages(spark, d):
    return table(spark, d, "pages").select(c("url").alias("key"))


_ENTRY = "CASE WHEN strpos(substring(url, {n}), '/') > 0 THEN substring(url, 1, {n} - 1 + strpos(substring(url, {n}), '/')) END"


def _page_sql(prefix, marker, limit, skip=""):
    cp = _ENTRY.format(n=len(prefix) + 1)
    inner = f"SELECT DISTINCT coalesce({cp}, url) AS entry, {cp} IS NOT NULL AS is_prefix FROM pages WHERE starts_with(url, '{prefix}') AND url > '{marker}'"
    return f"""WITH e AS (SELECT * FROM ({inner}) WHERE NOT (is_prefix AND entry = '{skip}') ORDER BY entry LIMIT {limit + 1})
 SELECT entry, is_prefix, (SELECT count(*) FROM e) > {limit} AS truncated FROM (SELECT * FROM e ORDER BY entry LIMIT {limit})"""


@query("list_v2", _page_sql("https://", "", 100))
def _(spark, d):
    return L.list_page(_pages(spark, d), "https://", "/", "", 100)


@query("list_v1", _page_sql("https://", "https://m/x", 50, "https://m/"))
def _(spark, d):
    return L.list_page(_pages(spark, d), "https://", "/", "https://m/x", 50)


@query("list_common_prefix", f"SELECT DISTINCT {_ENTRY.format(n=9)} AS prefix FROM pages WHERE starts_with(url, 'https://')")
def _(spark, d):
    p = L.common_prefix(c("key"), "https://", "/")
    return _pages(spark, d).filter(c("key").startswith("https://")).select(p.alias("prefix")).distinct()


_ORDER = "OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC)"


@query("win_is_latest", f"SELECT bucket, key, version_id, row_number() {_ORDER} = 1 AS is_latest FROM ({VERSIONS})")
def _(spark, d):
    return L.with_version_order(versions(spark, d), ["bucket", "key"]).select("bucket", "key", "version_id", "is_latest")


@query("win_successor", f"SELECT bucket, key, version_id, lag(mod_time) {_ORDER} AS successor_time FROM ({VERSIONS})")
def _(spark, d):
    return L.with_version_order(versions(spark, d), ["bucket", "key"]).select("bucket", "key", "version_id", "successor_time")


@query("win_num_versions", f"SELECT bucket, key, version_id, count(*) OVER (PARTITION BY bucket, key) AS num_versions FROM ({VERSIONS})")
def _(spark, d):
    return L.with_version_order(versions(spark, d), ["bucket", "key"]).select("bucket", "key", "version_id", "num_versions")


@query("list_versions", f"SELECT key, version_id, mod_time FROM ({VERSIONS}) WHERE key > 'k1' ORDER BY key, mod_time DESC, version_id DESC LIMIT 200")
def _(spark, d):
    return L.list_versions(versions(spark, d), "k1", None, 200).select("key", "version_id", "mod_time")


@query("src_list_objects", f"SELECT bucket, key, version_id, size FROM (SELECT *, row_number() {_ORDER} AS r FROM ({VERSIONS})) WHERE r = 1 AND NOT delete_marker")
def _(spark, d):
    ordered = L.with_version_order(versions(spark, d), ["bucket", "key"])
    return ordered.filter(c("is_latest") & ~c("delete_marker")).select("bucket", "key", "version_id", "size")


@query("list_versions_marker", f"""SELECT key, version_id, mod_time FROM ({VERSIONS}) v WHERE key > 'k10' OR (key = 'k10' AND (mod_time, version_id) < (SELECT (mod_time, version_id) FROM ({VERSIONS}) WHERE key = 'k10'
 ORDER BY mod_time DESC, version_id DESC LIMIT 1 OFFSET 1)) ORDER BY key, mod_time DESC, version_id DESC LIMIT 100""")
def _(spark, d):
    v = versions(spark, d)
    second = v.filter("key = 'k10'").orderBy(F.desc("mod_time"), F.desc("version_id")).limit(2).collect()[1]["version_id"]
    return L.list_versions(v, "k10", second, 100).select("key", "version_id", "mod_time")


@query("list_bucket", "SELECT DISTINCT event_type AS bucket FROM events WHERE event_type IN ('click', 'view', 'none')")
def _(spark, d):
    return L.list_bucket(versions(spark, d), spark.createDataFrame([("click",), ("view",), ("none",)], "bucket string"))


@query("list_with_metadata", "SELECT doc_id, lang AS meta_lang, CAST(2 AS BIGINT) AS n_meta, source AS tag_source, '12+4' AS ec FROM documents")
def _(spark, d):
    pairs = [("lang", c("lang")), ("size", c("n_chars").cast("string")), ("x-internal-etag", F.lit("1")), ("x-tagging", F.concat(F.lit("a=b%20c&source="), "source"))]
    objects = table(spark, d, "documents").select("doc_id", F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).alias("metadata"), F.lit(12).alias("data_blocks"), F.lit(4).alias("parity_blocks"))
    return L.with_metadata(objects).select("doc_id", c("metadata")["lang"].alias("meta_lang"), F.size("metadata").cast("bigint").alias("n_meta"), c("tags")["source"].alias("tag_source"), "ec")


@query("list_uploads", f"SELECT key, version_id AS upload_id, mod_time AS initiated FROM ({VERSIONS}) WHERE key LIKE 'k1%' AND (key > 'k15' OR (key = 'k15' AND version_id > 100)) ORDER BY mod_time, version_id LIMIT 1000")
def _(spark, d):
    uploads = versions(spark, d).select("key", c("version_id").alias("upload_id"), c("mod_time").alias("initiated"))
    return L.list_uploads(uploads, "k1", "k15", 100, 1000)


@query("list_parts", "SELECT CAST(l_partkey AS BIGINT) AS part_number, l_quantity AS size FROM lineitem WHERE l_suppkey = 3 AND l_partkey > 5 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1 ORDER BY 1 LIMIT 10000")
def _(spark, d):
    parts = table(spark, d, "lineitem").select(c("l_suppkey").alias("upload_id"), c("l_partkey").cast("bigint").alias("part_number"), c("l_quantity").alias("size"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("mod_time"))
    return L.list_parts(parts, 3, 5).select("part_number", "size")


@query("merge_pools", f"SELECT bucket, key, version_id, mod_time, size, delete_marker FROM ({VERSIONS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY mod_time DESC, version_id DESC) = 1")
def _(spark, d):
    v = versions(spark, d)
    return L.merged_pools(v.filter("version_id % 2 = 0"), v.filter("version_id % 2 = 1"), v.filter("version_id % 3 = 0"))


@query("out_notify_state", f"SELECT key, version_id, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mod_time DESC, version_id DESC) AS r FROM ({VERSIONS})) WHERE r = 1 AND NOT delete_marker")
def _(spark, d):
    v = versions(spark, d).select("key", "version_id", "mod_time", "size", "delete_marker")
    return L.latest_state(v, "key", ["mod_time", "version_id"], c("delete_marker")).select("key", "version_id", "size")


@query("win_retain_n", f"SELECT bucket, key, version_id FROM (SELECT *, row_number() {_ORDER} AS r, first_value(size) {_ORDER} AS latest_size FROM ({VERSIONS})) WHERE latest_size > 100000 AND r > 2")
def _(spark, d):
    from tidewater.operators.rules import beyond_newest

    return beyond_newest(versions(spark, d), c("size") > 100000, 2).select("bucket", "key", "version_id")
