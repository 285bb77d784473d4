"""The store's operators on small inputs with known answers."""

import datetime as dt
import random
import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import bursts, listing, metrics, policy, rules, sites, usage
from tidewater.storage import fresh_path
from tidewater.streaming import streams

T0 = dt.datetime(2024, 1, 1, 10)


DAY = "day string, bucket string, avg double, peak double, last double"


def by_day(spark, rows, first, last):
    storage = spark.createDataFrame(rows, DAY).withColumn("day", F.to_date("day"))
    return usage.storage_by_day(storage, first, last)


def test_a_gap_takes_the_last_record(spark):
    rows = [("2023-05-02", "raw", 10.0, 40.0, 20.0), ("2023-05-02", "tmp", 1.0, 1.0, 1.0), ("2023-05-05", "raw", 50.0, 90.0, 60.0)]
    got = {(r.day.day, r.bucket): (r.bytes, r.carried, r.peak) for r in by_day(spark, rows, "2023-05-01", "2023-05-06").collect()}
    assert got == {
        (2, "raw"): (10.0, False, 40.0), (2, "tmp"): (1.0, False, 1.0), (3, "raw"): (20.0, True, None), (3, "tmp"): (1.0, True, None), (4, "raw"): (20.0, True, None), (4, "tmp"): (1.0, True, None),
        (5, "raw"): (50.0, False, 90.0), (6, "raw"): (60.0, True, None),
    }


def test_records_before_a_period_carry_for_a_month(spark):
    rows = [("2023-03-01", "raw", 7.0, 7.0, 7.0)]
    assert by_day(spark, rows, "2023-04-01", "2023-04-02").count() == 2
    assert by_day(spark, rows, "2023-04-02", "2023-04-03").count() == 0


def test_a_day_weighs_as_its_month_has_days(spark):
    rows = [("2024-02-28", "raw", 29e9, 1.0, 29e9)]  # a leap year
    row = usage.gb_months(by_day(spark, rows, "2024-02-28", "2024-03-01")).first()
    assert round(row.gb_months, 9) == round(2 + 29 / 31, 9) and row.peak == 1.0


def test_periods():
    assert usage.period("2024-02-28", "2024-03-01")[1] == dt.date(2024, 3, 1)
    usage.period("2023-01-01", "2024-02-04")  # 400 days
    for first, last in (("2023-01-01", "2024-02-05"), ("2024-01-02", "2024-01-01"), ("2024-1-01", "2024-01-02"), ("2024-02-30", "2024-03-01"), ("x", "y")):
        with pytest.raises(ValueError):
            usage.period(first, last)


def test_report_has_storage_or_traffic_alone(spark):
    stored = by_day(spark, [("2023-06-01", "only-stored", 30e9, 5.0, 30e9)], "2023-06-01", "2023-06-01")
    moved = spark.createDataFrame([("only-moved", 2, 3, 5, 7, 11), ("only-moved", 20, 30, 50, 70, 110)], "bucket string, data_in long, data_out long, read long, write long, delete long")
    got = {r.bucket: (r.gb_months, r.data_in, r.data_out, r["read"], r["write"], r["delete"]) for r in usage.usage_report(stored, moved).collect()}
    assert got == {"only-stored": (1.0, 0, 0, 0, 0, 0), "only-moved": (0.0, 22, 33, 55, 77, 121)}


def test_teams(spark):
    teams = spark.createDataFrame([("zoo", ["a-1"], ["a-"]), ("art", ["a-1", "b"], ["a-1"]), ("bee", [], ["a-1", ""])], "name string, members array<string>, prefixes array<string>")
    names = spark.createDataFrame([("a-1",), ("a-12",), ("a-2",), ("b",), ("c",)], "bucket string")
    got = {r.bucket: (r.team, r.named_by_two) for r in usage.with_team(names, teams).collect()}
    assert got == {"a-1": ("art", True), "a-12": ("art", False), "a-2": ("zoo", False), "b": ("art", False), "c": ("bee", False)}
    assert "Cartesian" not in usage.with_team(names, teams)._jdf.queryExecution().executedPlan().toString()
    assert usage.with_team(names, teams.limit(0)).filter("team IS NULL").count() == 5


def test_segments(spark):
    rows = [("2024-03-09", 5), ("2024-03-09", 6), ("2024-03-08", 10), ("2024-03-07", 1), ("2024-01-01", 1)]
    segments = spark.createDataFrame(rows, "day string, bytes long").withColumn("day", F.to_date("day"))
    got = sorted((r.day.day, r.bytes, r.running) for r in usage.kept_segments(segments, "2024-03-10", 30, 21).collect())
    assert got == [(8, 10, 21), (9, 5, 11), (9, 6, 11)]


def test_usual_level_is_the_upper_median_of_busiest_hours(spark):
    schema = "day int, bucket string, kind string, hour int, n long"
    level = lambda rows, **k: {r.bucket: r.usual for r in bursts.usual(spark.createDataFrame(rows, schema), **k).collect()}
    ramp = [(day, "ramp", "overwritten", hour, 60 * day + hour) for day in range(14) for hour in (0, 5)]
    assert level(ramp) == {"ramp": 36}  # the eighth of 14 busiest hours has 425; five minutes of it, rounded up
    assert level([(0, "x", "deleted", 1, 30), (0, "x", "deleted", 1, 31), (1, "x", "deleted", 2, 10), (2, "x", "deleted", 2, 90)], days=3, minutes=60) == {"x": 61}
    assert level([(13, "late", "deleted", 1, 10**6), (14, "late", "deleted", 1, 10**6)]) == {"late": 0}


def test_bursts_name_their_top_credentials(spark):
    rows = [("inbox", f"key{i}", "destroyed", 10 * i) for i in range(1, 6)] + [("quiet", "key1", "destroyed", 149)]
    counts = spark.createDataFrame(rows, "bucket string, access_key string, kind string, n long")
    level = spark.createDataFrame([("inbox", "destroyed", 14)], "bucket string, kind string, usual long")
    found = lambda **k: [(r.bucket, r.n, r.usual, r.who) for r in bursts.bucket_bursts(counts, level, floor=150, **k).collect()]
    assert found() == [("inbox", 150, 14, ["key5", "key4", "key3"])]
    assert found(factor=150 / 14 + 0.01) == []
    assert found(excluded=("inbox",)) == []


def test_credentials_over_several_names(spark):
    rows = [("p", "wide", "deleted", 70), ("q", "wide", "deleted", 80), ("p", "narrow", "deleted", 500), ("q", "both", "overwritten", 90), ("r", "both", "overwritten", 61)]
    counts = spark.createDataFrame(rows, "bucket string, access_key string, kind string, n long")
    level = spark.createDataFrame([], "bucket string, kind string, usual long")
    one = bursts.bucket_bursts(counts.filter("kind = 'overwritten'"), level, floor=80)
    got = [(r.access_key, r.n, r.n_named) for r in bursts.credential_bursts(counts, one, level, floor=150).collect()]
    assert got == [("wide", 150, 2)]


def test_minutes_up_to_now(spark):
    at = lambda h, m, s: dt.datetime(2023, 7, 8, h, m, s)
    rows = [(at(23, 55, 59), 1), (at(23, 56, 0), 2), (at(23, 59, 59), 4), (at(0, 0, 0), 8)]
    counters = spark.createDataFrame([(t, "b", "k", "deleted", n) for t, n in rows], "ts timestamp_ntz, bucket string, access_key string, kind string, n long")
    total = lambda now, **k: sum(r.n for r in bursts.recent(counters, F.lit(now).cast("timestamp_ntz"), **k).collect())
    assert total(at(23, 59, 10)) == 7 and total(at(23, 59, 10), minutes=4) == 6 and total(at(23, 56, 30)) == 3


def test_incidents_open_go_on_and_close(spark):
    at = lambda m: dt.datetime(2023, 7, 8, 10) + dt.timedelta(minutes=m)
    now = lambda t: F.lit(t).cast("timestamp_ntz")
    kept = spark.createDataFrame([], "bucket string, kind string, opened timestamp_ntz, last_seen timestamp_ntz, closed timestamp_ntz, peak long")
    for minute, n in ((0, 50), (10, 90), (12, 70), (27, None), (40, 20)):
        seen = spark.createDataFrame([("b", "deleted", n)] if n else [], "bucket string, kind string, n long")
        kept = bursts.recorded(kept, seen, now(at(minute)))
    got = [tuple(r) for r in bursts.listed(kept).select("opened", "last_seen", "closed", "peak").collect()]
    assert got == [(at(40), at(40), None, 20), (at(0), at(12), at(27), 90)]
    assert bursts.listed(kept, open_only=True).count() == 1
    later = bursts.recorded(kept, spark.createDataFrame([], "bucket string, kind string, n long"), now(at(27) + dt.timedelta(days=90, seconds=1)))
    assert [r.opened for r in later.collect()] == [at(40)]


def test_filters_leave_incidents_whole(spark):
    at = lambda m: dt.datetime(2023, 7, 8, 10) + dt.timedelta(minutes=m)
    rows = [(at(m), "b", "deleted", n) for m, n in ((0, 9), (15, 2), (29, 3), (60, 8), (70, 4), (90, 1))]
    found = bursts.incidents(spark.createDataFrame(rows, "ts timestamp_ntz, bucket string, kind string, n long"))
    stored = lambda t, days: sorted((r.opened, r.closed, r.peak, r.seen) for r in bursts.stored(found, F.lit(t).cast("timestamp_ntz"), days).collect())
    assert [(r.opened, r.closes, r.peak) for r in found.filter(F.col("closes") >= at(40)).filter(F.col("opened") < at(50)).collect()] == [(at(0), at(44), 9)]
    assert stored(at(62), 1) == [(at(0), at(44), 9, 3), (at(60), None, 8, 2)]
    assert stored(at(40) + dt.timedelta(days=1), 1) == [(at(0), at(44), 9, 3), (at(60), at(85), 8, 2), (at(90), at(105), 1, 1)]


def test_access_for_everyone_and_members(spark):
    people = spark.createDataFrame([("ann",), ("bob",)], "principal string")
    members = spark.createDataFrame([("bob", "team")], "principal string, member_of string")
    grants = spark.createDataFrame([("*", "look", "Allow", True), ("team", "look", "Deny", False), ("ann", "edit", "Allow", False), ("team", "edit", "Deny", True)], "holder string, action string, effect string, certain boolean")
    review = policy.access_review(people, members, grants)
    assert {(r.principal, r.action): r.decision for r in review.collect()} == {("ann", "look"): "allowed", ("bob", "look"): "conditional", ("ann", "edit"): "conditional", ("bob", "edit"): "denied"}


def test_version_markers(spark):
    rows = [(k, v, T0 + dt.timedelta(minutes=v)) for k in ("a", "b", "c") for v in (1, 2, 3)]
    df = spark.createDataFrame(rows, "key string, version_id long, mod_time timestamp_ntz")
    page = lambda *x: [(r.key, r.version_id, r.is_latest) for r in listing.list_versions(df, *x).collect()]
    assert page("a", 2, 2) == [("a", 1, False), ("b", 3, True)]
    assert page("a", 1, 2) == [("b", 3, True), ("b", 2, False)]
    assert page("a", 9, 1) == [("b", 3, True)]
    assert page("b", None, 5) == [("c", 3, True), ("c", 2, False), ("c", 1, False)]


def test_late_rows_and_closed_windows(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, bucket string, access_key string, kind string, n long"
    rows = lambda *x: spark.createDataFrame([(t, "b", "k", "deleted", n) for t, n in x], schema).coalesce(1)
    path, out, state = (fresh_path(spark, n) for n in ("late", "late-out", "late-state"))
    for batch in (rows((at(10, 0), 1), (at(12, 0), 2)), rows((at(10, 0), 100), (at(11, 30), 4), (at(14, 0), 8))):
        batch.write.mode("append").parquet(path)
        slots = streams.minute_slots(spark.readStream.schema(schema).parquet(path))
        slots.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.minute, r.n) for r in spark.read.schema(slots.schema).parquet(out).collect())
    assert got == [(at(10, 0), 1), (at(11, 30), 4), (at(12, 0), 2)]  # the late hundred is left out, 14:00 is open


def versions(spark, n=5, locked=()):
    rows = [("k", i, T0 - dt.timedelta(days=i), 100, i in locked) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, version_id long, mod_time timestamp_ntz, size long, locked boolean")
    return listing.with_version_order(df, ["key"]).withColumn("delete_marker", F.lit(False))


def test_noncurrent_versions(spark):
    now = F.lit(T0 + dt.timedelta(days=30)).cast("timestamp_ntz")
    gone = lambda df: sorted(r.version_id for r in rules.noncurrent_kept(df, 1, 2, now).filter("deleted").collect())
    assert gone(versions(spark)) == [3, 4]
    assert gone(versions(spark, locked=(4,))) == [3]


def test_expiry(spark):
    due = lambda t, d: spark.range(1).select(rules.expected_expiry(F.lit(t).cast("timestamp_ntz"), d).cast("timestamp_ntz").alias("x")).first().x
    assert due("2024-01-01 10:00:00", 1) == dt.datetime(2024, 1, 3)
    assert due("2024-01-01 00:00:00", 30) == dt.datetime(2024, 2, 1)
    assert due("2024-01-01 10:00:00", 0) == T0


def test_lifecycle_sizes_are_strict_and_tags_all(spark):
    r = rules.LifecycleRule("r", tags={"env": "dev"}, size_gt=100, days=1)
    rows = [("a", 500, {"env": "dev"}), ("b", 100, {"env": "dev"}), ("c", 500, {"env": "prod"}), ("d", 500, {})]
    df = spark.createDataFrame(rows, "key string, size long, tags map<string,string>").withColumn("delete_marker", F.lit(False))
    assert [x.key for x in df.filter(rules.lifecycle_matches(r)).collect()] == ["a"]
    assert [x.key for x in df.filter(rules.expires(F.current_timestamp(), size_ge=500)).collect()] == ["a", "c", "d"]


def test_listing(spark):
    keys = ["a/1", "a/2", "b", "c/x/1", "c/y", "d"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    page = lambda *a: [(r.entry, r.is_prefix, r.truncated) for r in listing.list_page(df, *a).collect()]
    assert page("", "/", "", 10) == [("a/", True, False), ("b", False, False), ("c/", True, False), ("d", False, False)]
    assert page("", "/", "", 2) == [("a/", True, True), ("b", False, True)]
    assert [e for e, _, _ in page("", "/", "a/1", 10)] == ["b", "c/", "d"]
    assert [e for e, _, _ in page("c/", "/", "", 10)] == ["c/x/", "c/y"]
    assert [e for e, _, _ in page("", "", "b", 2)] == ["c/x/1", "c/y"]
    assert page("", "/", "", 0) == []


def test_policies(spark):
    context = F.create_map(F.lit("SourceIp"), F.array(F.lit("::ffff:10.0.0.9")))
    df = spark.range(1).select(F.lit("s3:GetObject").alias("action"), F.lit("b").alias("bucket"), F.lit("o").alias("object"), F.lit("u").alias("principal"), context.alias("context"))
    may = lambda *s, **k: df.select(policy.allowed(list(s), **k).alias("x")).first().x
    allow, deny = policy.Statement("Allow", ("s3:*",)), policy.Statement("Deny", ("s3:Get*",), conditions=(("IpAddress", "aws:SourceIp", ("10.0.0.0/24",)),))
    assert (may(), may(allow), may(allow, deny), may(owner=F.lit(True)), may(deny, owner=F.lit(True))) == (False, True, False, True, False)
    assert may(allow, policy.Statement("Deny", conditions=(("NotIpAddress", "aws:SourceIp", ("10.0.0.0/8",)),)))
    rows = [("p", "a", "Allow", True), ("p", "a", "Deny", False), ("p", "b", "Allow", False), ("p", "c", "Deny", True), ("p", "c", "Allow", True), ("p", "d", "Deny", False)]
    got = {r.action: r.decision for r in policy.decide(spark.createDataFrame(rows, "principal string, action string, effect string, certain boolean")).collect()}
    assert got == {"a": "conditional", "b": "conditional", "c": "denied", "d": "none"}


def test_text_functions(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert [one(X.parse_bytes(F.lit(s))) for s in ("10MiB", "5 MB", "1,000", "x")] == [10 << 20, 5_000_000, 1000, None]
    assert [one(X.parse_duration(F.lit(s))) for s in ("1h30m", "-2d", "0", "1.5s", "h")] == [5400 * 10**9, -2 * 86400 * 10**9, 0, 1_500_000_000, None]
    assert one(X.parse_tags(F.lit("a=1&b=x%20y&c"))) == {"a": "1", "b": "x y", "c": ""}
    assert one(X.in_cidr(F.lit("nonsense"), "0.0.0.0/0")) is False
    assert one(X.wildcard(F.lit("a.b"), "a?b")) and not one(X.wildcard(F.lit("axxb"), "a.*b"))


def test_decaying_average(spark):
    xs = [3.0, 10.0, 4.0, 8.0]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), i, x) for i, x in enumerate(xs)], "by string, ts timestamp, seq int, x double")
    want = xs[0]
    for x in xs[1:]:
        want = 0.9 * want + 0.1 * x
    assert abs(metrics.decaying(df, "by").first().ewma - want) < 1e-12


def test_alert_windows_against_all_pairs(spark):
    rng, hour = random.Random(4), dt.timedelta(hours=1)
    times = [dt.datetime(1969, 12, 31, 23, 59) + dt.timedelta(microseconds=rng.randrange(90_000_000)) for _ in range(400)]
    times += [t + dt.timedelta(seconds=k) for t in times[:40] for k in (7, 14)] + [T0, T0 + hour, T0 + hour + dt.timedelta(seconds=7), T0 + hour + dt.timedelta(seconds=7, microseconds=1)]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, *range(20)])) for i, t in enumerate(times)]
    rows += [(len(rows) + i, by, t, v) for i, (_, by, t, v) in enumerate(rows[:50])]  # equal samples
    df = spark.createDataFrame(rows, "id long, by string, ts timestamp_ntz, value long")
    got = {r.id: tuple(r)[1:] for r in metrics.over_time(df, "by", 7).select("id", "increase", "rate", "delta", "max_over_time").collect()}
    second = lambda t: t.replace(microsecond=0)
    for by in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == by), key=lambda r: (r[2], -1 if r[3] is None else r[3]))
        steps = [0] + [0 if None in (v, u) else v if v < u else v - u for (_, _, _, u), (_, _, _, v) in pairwise(mine)]
        for i, _, t, v in mine:
            since = t - dt.timedelta(seconds=7)
            total = sum(n for n, r in zip(steps, mine, strict=True) if second(since) <= second(r[2]) <= second(t))
            first = next(r[3] for r in mine if r[2] >= since)
            most = max((r[3] for r in mine if r[3] is not None and second(since) <= second(r[2]) <= second(t)), default=None)
            assert got.pop(i) == (total, total / 7, None if None in (v, first) else v - first, most)
    assert not got
    assert {r.id: r.increase for r in metrics.increase(df, "by", 7).collect()} == {r.id: r.increase for r in metrics.over_time(df, "by", 7).collect()}


def test_alert_windows_are_running_aggregates_of_blocks(spark):
    df = spark.range(5).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 2).alias("by"), F.col("id").alias("value"))
    plan = metrics.over_time(df, "by", 21600)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe\((.*?), currentrow|windowspecdefinition\((.*?), specifiedwindowframe\((RowFrame, -?1)", plan)
    assert len(specs) >= 6
    assert all(re.match(r"by#\d+L, _block#", a or b) for a, _, b, _ in specs)
    assert {x or y for _, x, _, y in specs} == {"RangeFrame, unboundedpreceding$()", "RowFrame, unboundedpreceding$()", "RowFrame, -1", "RowFrame, 1"}


def test_sites(spark):
    rows = [(s, "all", "v") for s in "abc"] + [("a", "some", "v"), ("a", "differ", "v"), ("b", "differ", "v"), ("c", "differ", "w")]
    got = {r.entity: r.replicated for r in sites.site_status(spark.createDataFrame(rows, "site string, entity string, value string"), 3).collect()}
    assert got == {"all": True, "some": False, "differ": False}
