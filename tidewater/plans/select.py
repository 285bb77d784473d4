"""Queries of the Select dialect: projections, predicates, functions and global aggregates over typed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import select as S
from tidewater.plans.registry import query
from tidewater.session import table
from tidewater.sources import sinks

c = F.col


@query("sel_star", "SELECT * FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("*")


@query("sel_exprs", "SELECT l_returnflag, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))


@query("sel_alias", "SELECT p_partkey AS id, p_name AS \"the name\" FROM part")
def _(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_name").alias("the name"))


@query("sel_autoname", "SELECT p_name, p_size + 1 AS _2 FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_name", (c("p_size") + 1).alias("_2"))


@query("where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def _(spark, d):
    return table(spark, d, "lineitem").filter(c("l_quantity") > 40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("and_or_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount = 0.1) AND NOT l_returnflag = 'A'")
def _(spark, d):
    keep = ((c("l_quantity") > 45) | (c("l_discount") == 0.1)) & ~S.eq(c("l_returnflag"), F.lit("A"))
    return table(spark, d, "lineitem").filter(keep).select("l_orderkey", "l_linenumber")


_NULLED = "SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS k FROM customer"


def _nulled(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(c("c_nationkey") > 5, c("c_nationkey")).alias("k"))


@query(
    "cmp",
    f"SELECT c_custkey, k IS NOT DISTINCT FROM 7 AS eq, k IS DISTINCT FROM 7 AS ne, k IS NOT DISTINCT FROM NULL AS eq_null, coalesce(k < 9, false) AS lt, coalesce(k >= 9, false) AS ge FROM ({_NULLED})",
)
def _(spark, d):
    k = c("k")
    return _nulled(spark, d).select(
        "c_custkey", S.eq(k, F.lit(7)).alias("eq"), (~S.eq(k, F.lit(7))).alias("ne"), S.eq(k, F.lit(None).cast("int")).alias("eq_null"),
        S.ordered(k, "<", F.lit(9)).alias("lt"), S.ordered(k, ">=", F.lit(9)).alias("ge"),
    )


@query("cmp_float_tol", "SELECT p_partkey, abs(p_retailprice - 900.0000004) < 1e-6 AS eq, abs(p_retailprice - 900.0000004) > 1e-6 AS ne FROM part")
def _(spark, d):
    price = c("p_retailprice")
    return table(spark, d, "part").select("p_partkey", S.eq_float(price, F.lit(900.0000004)).alias("eq"), S.ne_float(price, F.lit(900.0000004)).alias("ne"))


@query(
    "infer_cmp",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS num, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50, false) AS gt FROM events",
)
def _(spark, d):
    num = S.untyped_number(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", num.alias("num"), S.ordered(num, ">", F.lit(50)).alias("gt"))


@query(
    "is_missing",
    "SELECT event_id, json_extract(props, '$.nope') IS NULL AS missing, json_extract(props, '$.k') IS NULL AS k_missing FROM events",
)
def _(spark, d):
    v = F.parse_json("props")
    missing = lambda p: F.try_variant_get(v, p, "variant").isNull()
    return table(spark, d, "events").select("event_id", missing("$.nope").alias("missing"), missing("$.k").alias("k_missing"))


@query("is_null", f"SELECT c_custkey, k IS NULL AS n, k IS NOT NULL AS nn FROM ({_NULLED})")
def _(spark, d):
    return _nulled(spark, d).select("c_custkey", c("k").isNull().alias("n"), c("k").isNotNull().alias("nn"))


@query("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def _(spark, d):
    return table(spark, d, "orders").filter(c("o_totalprice").between(1000, 50000)).select("o_orderkey")


@query("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 11) OR p_type IN ('ECONOMY', 'PROMO')")
def _(spark, d):
    return table(spark, d, "part").filter(c("p_size").isin(1, 5, 11) | c("p_type").isin("ECONOMY", "PROMO")).select("p_partkey")


@query("in_path", "SELECT vec_id, len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) < 1e-6)) > 0 AS found FROM embeddings")
def _(spark, d):
    values = c("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", S.in_list(F.get(values, F.lit(0)), values).alias("found"))


@query("like", "SELECT p_partkey FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'r_d%'")
def _(spark, d):
    return table(spark, d, "part").filter(c("p_name").like("%ring") | c("p_name").like("r_d%")).select("p_partkey")


@query("like_escape", "SELECT doc_id FROM documents WHERE text LIKE '%!%%' ESCAPE '!'")
def _(spark, d):
    return table(spark, d, "documents").filter(F.like(c("text"), F.lit("%!%%"), F.lit("!"))).select("doc_id")


@query("arith", "SELECT p_partkey, p_size + 3 AS a, p_size - 30 AS s, p_size * 2 AS m, CAST((p_size - 30) // 4 AS BIGINT) AS q, (p_size - 30) % 4 AS r FROM part")
def _(spark, d):
    size = c("p_size")
    return table(spark, d, "part").select("p_partkey", (size + 3).alias("a"), (size - 30).alias("s"), (size * 2).alias("m"), S.int_div(size - 30, F.lit(4)).alias("q"), ((size - 30) % 4).alias("r"))


@query("neg", "SELECT c_custkey, -c_acctbal AS x FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", (-c("c_acctbal")).alias("x"))


@query(
    "array_cmp",
    """SELECT l_orderkey, l_linenumber, [l_linenumber % 2, CAST(l_quantity AS INTEGER) % 3] = [1, 2] AS same, l_linenumber % 2 <> 1 OR CAST(l_quantity AS INTEGER) % 3 <> 2 AS differ,
 l_linenumber % 2 <> 1 AS differ_short, false AS same_short FROM lineitem""",
)
def _(spark, d):
    x = F.array(c("l_linenumber") % 2, c("l_quantity").cast("int") % 3)
    two, one = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.array_eq(x, two).alias("same"), S.array_ne(x, two).alias("differ"), S.array_ne(x, one).alias("differ_short"), S.array_eq(x, one).alias("same_short")
    )


@query("list_lit", "SELECT n_nationkey, [n_nationkey, n_regionkey] AS pair FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey").alias("pair"))


@query("path_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("path_index", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[1000] AS DOUBLE) AS beyond FROM embeddings")
def _(spark, d):
    e = c("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.get(e, F.lit(0)).alias("first"), F.get(e, F.lit(999)).alias("beyond"))


@query("path_arrwild", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n_pos FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("n_pos"))


@query("path_objwild", "SELECT event_id, json_keys(props) AS ks FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.json_object_keys("props").alias("ks"))


@query("from_path", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).select("vec_id", c("x").cast("double").alias("x"))


@query("short_circuit", "SELECT l_orderkey, l_linenumber, l_linenumber <> 1 AND 10 // (l_linenumber - 1 + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) > 3 AS x FROM lineitem")
def _(spark, d):
    n = c("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.both(n != 1, F.expr("10 div (l_linenumber - 1)") > 3).alias("x"))


@query("from_table", "SELECT s.r_name FROM region AS s")
def _(spark, d):
    return table(spark, d, "region").alias("s").select(c("s.r_name"))


@query("ident_quoted", 'SELECT n_name AS "na.me" FROM nation')
def _(spark, d):
    return table(spark, d, "nation").select(c("n_name").alias("na.me")).select(c("`na.me`"))


# --- functions -----------------------------------------------------------------------------------------------------


@query("fn_coalesce", f"SELECT c_custkey, coalesce(k, -1) AS k FROM ({_NULLED})")
def _(spark, d):
    return _nulled(spark, d).select("c_custkey", F.coalesce("k", F.lit(-1)).alias("k"))


@query("fn_nullif", "SELECT p_partkey, CASE WHEN NOT abs(p_size - 11) < 1e-6 THEN p_size END AS x FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.nullif(c("p_size"), F.lit(11)).alias("x"))


_TEXTS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat(event_id, '.75') WHEN 2 THEN '1e3' WHEN 3 THEN '1d' ELSE 'True' END AS t FROM events"


def _texts(spark, d):
    n, s = c("event_id") % 5, c("event_id").cast("string")
    text = F.when(n == 0, s).when(n == 1, F.concat(s, F.lit(".75"))).when(n == 2, "1e3").when(n == 3, "1d").otherwise("True")
    return table(spark, d, "events").select("event_id", text.alias("t"))


_NUMBERS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat('-', event_id, '.75') WHEN 2 THEN '1e3' WHEN 3 THEN '1d' WHEN 4 THEN 'True' WHEN 5 THEN '1e30'
 WHEN 6 THEN concat('0x', event_id % 10, '.8p3') END AS t, event_id % 8 AS m, 8 * (event_id % 10) + 4 AS hex FROM events"""


def _numbers(spark, d):
    n, s = c("event_id") % 8, c("event_id").cast("string")
    text = F.when(n == 0, s).when(n == 1, F.concat(F.lit("-"), s, F.lit(".75"))).when(n == 2, "1e3").when(n == 3, "1d").when(n == 4, "True").when(n == 5, "1e30")
    text = text.when(n == 6, F.concat(F.lit("0x"), (c("event_id") % 10).cast("string"), F.lit(".8p3")))
    return table(spark, d, "events").select("event_id", text.alias("t"))


@query("fn_cast_int", f"SELECT event_id, CASE m WHEN 5 THEN CAST(-9223372036854775808 AS BIGINT) WHEN 6 THEN CAST(hex AS BIGINT) ELSE CAST(trunc(try_cast(t AS DOUBLE)) AS BIGINT) END AS x FROM ({_NUMBERS}) t")
def _(spark, d):
    return _numbers(spark, d).select("event_id", S.cast_int(c("t")).alias("x"))


@query("fn_cast_float", f"SELECT event_id, CASE m WHEN 6 THEN CAST(hex AS DOUBLE) ELSE try_cast(t AS DOUBLE) END AS x FROM ({_NUMBERS}) t")
def _(spark, d):
    return _numbers(spark, d).select("event_id", S.cast_float(c("t")).alias("x"))


@query("fn_cast_bool", f"SELECT event_id, CASE lower(t) WHEN 'true' THEN true WHEN 'false' THEN false END AS x FROM ({_TEXTS}) t")
def _(spark, d):
    return _texts(spark, d).select("event_id", S.cast_bool(c("t")).alias("x"))


@query(
    "fn_cast_string",
    f"""SELECT c_custkey, coalesce(CAST(k AS VARCHAR), 'NULL') AS i, CASE c_custkey % 3 WHEN 0 THEN '2.5' WHEN 1 THEN '1e+07' ELSE '5e-05' END AS f, CAST(c_custkey % 2 = 0 AS VARCHAR) AS b,
 CASE WHEN c_custkey % 2 = 0 THEN '2024-03T' ELSE '2024-03-01T07:00Z' END AS t FROM ({_NULLED})""",
)
def _(spark, d):
    n = c("c_custkey")
    f = F.when(n % 3 == 0, 2.5).when(n % 3 == 1, 1e7).otherwise(0.00005)
    t = F.when(n % 2 == 0, F.lit("2024-03-01 00:00:00")).otherwise("2024-03-01 07:00:00").cast("timestamp")
    return _nulled(spark, d).select("c_custkey", S.cast_string(c("k"), "int").alias("i"), S.cast_string(f, "float").alias("f"), S.cast_string(n % 2 == 0, "bool").alias("b"), S.cast_string(t, "timestamp").alias("t"))


_STAMPS = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%YT') WHEN 1 THEN strftime(o_orderdate, '%Y-%mT')
 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT') ELSE strftime(o_orderdate, '%Y-%m-%dT07:08Z') END"""


def _stamps(spark, d):
    n, t = c("o_orderkey") % 4, c("o_orderdate")
    text = F.when(n == 0, F.date_format(t, "yyyy'T'")).when(n == 1, F.date_format(t, "yyyy-MM'T'")).when(n == 2, F.date_format(t, "yyyy-MM-dd'T'")).otherwise(F.date_format(t, "yyyy-MM-dd'T07:08Z'"))
    return table(spark, d, "orders").withColumn("t", text)


_STAMP_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate)
 WHEN 2 THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) + INTERVAL 428 MINUTE END AS ts FROM orders"""


@query("fn_cast_timestamp", _STAMP_SQL)
def _(spark, d):
    return _stamps(spark, d).select("o_orderkey", S.cast_timestamp(c("t")).cast("timestamp_ntz").alias("ts"))


@query("fn_to_timestamp", _STAMP_SQL)
def _(spark, d):
    return _stamps(spark, d).select("o_orderkey", S.cast_timestamp(c("t")).cast("timestamp_ntz").alias("ts"))


@query(
    "fmt_timestamp",
    f"""SELECT o_orderkey, CASE WHEN strftime(ts, '%m-%d %H:%M') = '01-01 00:00' THEN strftime(ts, '%YT') WHEN strftime(ts, '%d %H:%M') = '01 00:00' THEN strftime(ts, '%Y-%mT')
 WHEN strftime(ts, '%H:%M') = '00:00' THEN strftime(ts, '%Y-%m-%dT') ELSE strftime(ts, '%Y-%m-%dT%H:%MZ') END AS x FROM ({_STAMP_SQL})""",
)
def _(spark, d):
    return _stamps(spark, d).select("o_orderkey", S.format_timestamp(S.cast_timestamp(c("t"))).alias("x"))


@query("fn_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, greatest(-3, 1), 4) AS b, substring(p_name, 4) AS e FROM part")
def _(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select("p_partkey", S.substring(n, 2, 3).alias("a"), S.substring(n, -3, 4).alias("b"), S.substring(n, 4).alias("e"))


@query("fn_trim", "SELECT p_partkey, trim(p_name, 'rsg') AS b, ltrim(p_name, 'sr') AS l, rtrim(p_name, 'tg') AS t FROM part")
def _(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select("p_partkey", S.trim(n, "BOTH", "rsg").alias("b"), S.trim(n, "LEADING", "sr").alias("l"), S.trim(n, "TRAILING", "tg").alias("t"))


@query("fn_char_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@query("fn_lower", "SELECT p_partkey, lower(p_brand) AS x FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("x"))


@query("fn_upper", "SELECT p_partkey, upper(p_name) AS x FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.upper(c("p_name")).alias("x"))


@query(
    "fn_extract",
    """SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s,
 CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN -3 ELSE 0 END AS tz_h, CASE event_id % 3 WHEN 0 THEN 45 WHEN 1 THEN -30 ELSE 0 END AS tz_m FROM events""",
)
def _(spark, d):
    t, long = c("ts"), lambda x: x.cast("bigint")
    n = c("event_id") % 3
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(n == 0, "+05:45").when(n == 1, "-03:30").otherwise("Z"))
    zone = [S.timezone_part(text, p).alias(a) for p, a in (("TIMEZONE_HOUR", "tz_h"), ("TIMEZONE_MINUTE", "tz_m"))]
    return table(spark, d, "events").select("event_id", *[long(f(t)).alias(n) for f, n in ((F.year, "y"), (F.month, "mo"), (F.dayofmonth, "d"), (F.hour, "h"), (F.minute, "mi"), (F.second, "s"))], *zone)


@query(
    "fn_date_add",
    """SELECT o_orderkey, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)) AS month,
 o_orderdate + INTERVAL 3 DAY AS day, o_orderdate + INTERVAL 5 HOUR AS hour FROM orders""",
)
def _(spark, d):
    t = c("o_orderdate").cast("timestamp")
    ntz = lambda x: x.cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", ntz(S.date_add("MONTH", 1, t)).alias("month"), ntz(S.date_add("DAY", 3, t)).alias("day"), ntz(S.date_add("HOUR", 5, t)).alias("hour"))


@query(
    "fn_date_diff",
    """SELECT event_id, CAST(date_sub('day', a, ts) AS BIGINT) AS d, CAST(date_sub('hour', a, ts) AS BIGINT) AS h, CAST(date_diff('month', a, ts) AS BIGINT) AS mo,
 CAST(year(ts) - year(a) - CASE WHEN strftime(ts, '%m%d%H%M%S') < strftime(a, '%m%d%H%M%S') THEN 1 ELSE 0 END AS BIGINT) AS y
 FROM (SELECT *, TIMESTAMP '2021-01-15 12:00:00' AS a FROM events)""",
)
def _(spark, d):
    a, b = F.lit("2021-01-15 12:00:00").cast("timestamp"), c("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", *[S.date_diff(p, a, b).alias(n) for p, n in (("DAY", "d"), ("HOUR", "h"), ("MONTH", "mo"), ("YEAR", "y"))])


@query(
    "fn_to_string",
    """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS a, concat(strftime(ts, '%y-'), month(ts), '-', day(ts), ' ', (hour(ts) + 11) % 12 + 1, ' ', CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END) AS b,
 concat(strftime(ts, '%B %b '), left(strftime(ts, '%B'), 1), ' o''clock ', lpad(CAST(hour(ts) AS VARCHAR), 3, '0'), 'Z+00:00') AS e, strftime(ts, '%S.%f000') AS f FROM events""",
)
def _(spark, d):
    t = c("ts")
    patterns = {"a": "yyyy/MM/dd HH:mm", "b": "yy-M-d h a", "e": "MMMM MMM MMMMM 'o''clock' HHHXxxx", "f": "ss.SSSSSSSSS"}
    return table(spark, d, "events").select("event_id", *[S.to_string(t, x).alias(n) for n, x in patterns.items()])


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("agg_count_star", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("agg_count", f"SELECT count(k) AS n, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS in_json, (SELECT count(*) FROM customer) AS in_csv FROM ({_NULLED})")
def _(spark, d):
    n = c("event_id") % 3
    documents = table(spark, d, "events").select(F.parse_json(F.when(n == 0, '{"k": null}').when(n == 1, '{"k": 5}').otherwise("{}")).alias("v"))
    columns = [_nulled(spark, d).agg(F.count("k").alias("n")), documents.agg(S.count_json(c("v"), "$.k").alias("in_json")), _nulled(spark, d).agg(S.count_csv(c("k")).alias("in_csv"))]
    parts = [x.select(F.lit(0).alias("one"), "*") for x in columns]
    return parts[0].join(parts[1], "one").join(parts[2], "one").drop("one")


@query("agg_sum", "SELECT coalesce(round(sum(CAST(l_quantity AS DOUBLE)), 2), 0) AS s FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.round(S.total(c("l_quantity")), 2).alias("s"))


@query("agg_avg", "SELECT round(avg(l_extendedprice), 4) AS a FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.avg("l_extendedprice"), 4).alias("a"))


@query("agg_min_max", "SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS pl, max(p_retailprice) AS ph FROM part")
def _(spark, d):
    return table(spark, d, "part").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_retailprice").alias("pl"), F.max("p_retailprice").alias("ph"))


@query("agg_expr", "SELECT round(sum(l_extendedprice) / count(*) * 2, 4) AS x, max(l_quantity) - min(l_quantity) AS spread FROM lineitem WHERE l_discount > 0.05")
def _(spark, d):
    df = table(spark, d, "lineitem").filter(c("l_discount") > 0.05)
    return df.agg(F.round(F.sum("l_extendedprice") / F.count("*") * 2, 4).alias("x"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@query("agg_empty", "SELECT count(*) AS n, coalesce(sum(l_quantity), 0) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity < 0")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity < 0").agg(F.count("*").alias("n"), S.total(c("l_quantity")).alias("s"), F.avg("l_quantity").alias("a"))


@query("limit", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 40 ORDER BY ALL LIMIT 25")
def _(spark, d):
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return table(spark, d, "lineitem").filter("l_quantity > 40").select(*names).orderBy(*names).limit(25)


@query("lit", "SELECT r_regionkey, 1.5 AS f, 'it''s' AS s, true AS b FROM region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.lit(1.5).cast("decimal(2,1)").alias("f"), F.lit("it's").alias("s"), F.lit(True).alias("b"))


@query("fn_utcnow", "SELECT event_id, event_id % 2 = 0 AS past, CAST(1 AS BIGINT) AS n_instants FROM events")
def _(spark, d):
    at = c("ts").cast("timestamp") + F.when(c("event_id") % 2 == 0, F.expr("INTERVAL '0' YEAR")).otherwise(F.expr("INTERVAL '900' YEAR"))
    rows = table(spark, d, "events").select("event_id", (S.utcnow() > at).alias("past"), S.utcnow().alias("now"))
    instants = rows.agg(F.count_distinct("now").alias("n_instants"), F.first("now").alias("now"))
    return rows.join(instants, "now").select("event_id", "past", "n_instants")


@query("sel_dup_cols", """SELECT concat(n_name, ',', n_name) AS csv, concat('{"n_name":"', n_name, '","n_name":"', n_name, '"}') AS json FROM nation""")
def _(spark, d):
    twice = table(spark, d, "nation").select("n_name", "n_name")
    names, rows = twice.columns, twice.toDF("_1", "_2")
    return rows.select(sinks.csv_line(c("_1"), c("_2")).alias("csv"), sinks.json_record([(n, sinks.json_text(c(f"_{i}"))) for i, n in enumerate(names, 1)]).alias("json"))


@query("nested_predicate", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0")
def _(spark, d):
    return table(spark, d, "embeddings").filter(F.exists("embedding", lambda x: x > F.lit(0.3).cast("float"))).select("vec_id")
