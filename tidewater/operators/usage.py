"""Usage of each bucket: histograms, totals, tiers, compliance counts, daily history, team reports, cost."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and lower bounds of the object size and version count bins.
KIB, MIB = 1024, 1024 * 1024
SIZE_BINS = [
    ("LESS_THAN_1024_B", 0, KIB),
    ("BETWEEN_1024_B_AND_64_KB", KIB, 64 * KIB),
    ("BETWEEN_64_KB_AND_256_KB", 64 * KIB, 256 * KIB),
    ("BETWEEN_256_KB_AND_512_KB", 256 * KIB, 512 * KIB),
    ("BETWEEN_512_KB_AND_1_MB", 512 * KIB, MIB),
    ("BETWEEN_1_MB_AND_10_MB", MIB, 10 * MIB),
    ("BETWEEN_10_MB_AND_64_MB", 10 * MIB, 64 * MIB),
    ("BETWEEN_64_MB_AND_128_MB", 64 * MIB, 128 * MIB),
    ("BETWEEN_128_MB_AND_512_MB", 128 * MIB, 512 * MIB),
    ("GREATER_THAN_512_MB", 512 * MIB, None),
]
#: The sum of the four bins from 1 KiB to 1 MiB.
SIZE_SUM_BIN = "BETWEEN_1024B_AND_1_MB"
VERSION_BINS = [
    ("UNVERSIONED", 0, 1),
    ("SINGLE_VERSION", 1, 2),
    ("BETWEEN_2_AND_10", 2, 10),
    ("BETWEEN_10_AND_100", 10, 100),
    ("BETWEEN_100_AND_1000", 100, 1000),
    ("BETWEEN_1000_AND_10000", 1000, 10000),
    ("GREATER_THAN_10000", 10000, None),
]
# Beginnings of API names that count as writes.
WRITES = ("put", "post", "copy", "new", "complete", "abort", "reset")


def _inside(x: Column, low: int, high: int | None) -> Column:
    return (x >= low) if high is None else (x >= low) & (x < high)


def size_histogram(objects: DataFrame, bucket: str = "bucket", size: str = "size") -> DataFrame:
    """A row for each bucket, a column for each size bin. One partial aggregate, no join."""
    counts = [F.count_if(_inside(F.col(size), low, high)).alias(name) for name, low, high in SIZE_BINS]
    wide = objects.groupBy(bucket).agg(*counts)
    return wide.withColumn(SIZE_SUM_BIN, sum((F.col(n) for n, _, _ in SIZE_BINS[1:5]), F.lit(0)))


def version_histogram(versions: DataFrame, bucket: str = "bucket", key: str = "key") -> DataFrame:
    """A row for each bucket, a column for each bin of versions per key: first by key, then by bucket."""
    by_key = versions.groupBy(bucket, key).agg(F.count("*").alias("n"))
    return by_key.groupBy(bucket).agg(*[F.count_if(_inside(F.col("n"), low, high)).alias(name) for name, low, high in VERSION_BINS])


def bucket_usage(versions: DataFrame) -> DataFrame:
    """(bucket, objects, versions, delete_markers, size) from (bucket, key, size, delete_marker)."""
    live = ~F.col("delete_marker")
    by_key = versions.groupBy("bucket", "key").agg(F.count_if(live).alias("v"), F.count_if(~live).alias("m"), F.sum(F.when(live, F.col("size")).otherwise(0)).alias("s"))
    return by_key.groupBy("bucket").agg(F.count("*").alias("objects"), F.sum("v").alias("versions"), F.sum("m").alias("delete_markers"), F.sum("s").alias("size"))


def total_usage(usage: DataFrame) -> DataFrame:
    """One row over all rows of ``bucket_usage``."""
    return usage.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("objects", "versions", "delete_markers", "size")])


def tier_usage(versions: DataFrame, tiers: list[str]) -> DataFrame:
    """(tier, versions, size, objects) for the known tiers, zero rows included; only latest versions count as objects."""
    known = versions.sparkSession.createDataFrame([(t,) for t in tiers], "tier string")
    stored = versions.withColumn("tier", F.coalesce("tier", F.lit("STANDARD"))).filter(F.col("tier").isin(tiers))
    sums = stored.groupBy("tier").agg(F.count("*").alias("versions"), F.sum("size").alias("size"), F.count_if("is_latest").alias("objects"))
    return known.join(sums, "tier", "left").fillna(0, ["versions", "size", "objects"])


def compliance_counts(versions: DataFrame, now: Column) -> DataFrame:
    """Versions and bytes of each bucket by encryption, retention in force and legal hold; delete markers don't count.

    Columns: bucket, sse (null for plain), lock_mode, retain_until, legal_hold, size, delete_marker.
    """
    held = (F.col("retain_until") > now) & F.col("lock_mode").isNotNull()
    kinds = {
        "plain": F.col("sse").isNull(), "sse_s3": F.col("sse") == "S3", "sse_kms": F.col("sse") == "KMS", "sse_c": F.col("sse") == "C",
        "compliance": held & (F.upper("lock_mode") == "COMPLIANCE"), "governance": held & (F.upper("lock_mode") == "GOVERNANCE"),
        "legal_hold": F.upper(F.col("legal_hold")) == "ON",
    }
    columns = []
    for name, test in kinds.items():
        columns += [F.count_if(test).alias(f"{name}_count"), F.sum(F.when(test, F.col("size")).otherwise(0)).alias(f"{name}_bytes")]
    until = F.max(F.when(held & F.upper("lock_mode").isin("COMPLIANCE", "GOVERNANCE"), F.col("retain_until"))).alias("latest_until")
    return versions.filter(~F.col("delete_marker")).groupBy("bucket").agg(*columns, until)


def api_kind(api: Column) -> Column:
    """read, write or delete by the API's name."""
    write = F.lit(False)
    for w in WRITES:
        write = write | api.startswith(w)
    return F.when(api.startswith("delete"), "delete").when(write, "write").otherwise("read")


def running_day(samples: DataFrame) -> DataFrame:
    """(day, bucket, avg, peak, last, n) of samples (ts, bucket, bytes)."""
    return samples.groupBy(F.to_date("ts").alias("day"), "bucket").agg(
        F.avg("bytes").alias("avg"), F.max("bytes").alias("peak"), F.max_by("bytes", "ts").alias("last"), F.count("*").alias("n")
    )


def merge_traffic(records: DataFrame) -> DataFrame:
    """Counters of all servers added up: (day, bucket, hours) with hours an array of 24 sums; hours out of range count as 0."""
    hour = F.when(F.col("hour").between(0, 23), F.col("hour")).otherwise(0)
    by_hour = records.groupBy("day", "bucket", hour.alias("hour")).agg(F.sum("n").alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.struct("hour", "n")))
    return by_hour.groupBy("day", "bucket").agg(pairs.alias("by")).select(
        "day", "bucket", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at(F.col("by"), h), F.lit(0))).alias("hours")
    )


def storage_by_day(storage: DataFrame, first: str, last: str, look_back: int = 31) -> DataFrame:
    """Storage for each day of a period, with the last known record carried over days without one.

    storage: (day, bucket, avg, peak, last). A day takes the whole newest record of at most ``look_back`` days before
    the period on; a bucket that is absent from that record is absent. Days with a record of their own add avg, carried ones
    last. Returns (day, bucket, bytes, carried, peak).
    """
    period(first, last)
    spine = storage.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    seen = storage.filter(F.col("day").between(F.date_sub(F.lit(first).cast("date"), look_back), F.lit(last).cast("date")))
    days = seen.select("day").distinct().withColumn("source", F.col("day"))
    # The days of a period and the look-back are few, so the order over all of them is no burden.
    ends = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carried = spine.join(days, "day", "full").withColumn("source", F.last("source", ignorenulls=True).over(ends))
    carried = carried.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("source").isNotNull())
    own = F.col("day") == F.col("source")
    return carried.join(seen.withColumnRenamed("day", "source"), "source").select(
        "day", "bucket", F.when(own, F.col("avg")).otherwise(F.col("last")).alias("bytes"), (~own).alias("carried"), F.when(own, F.col("peak")).alias("peak")
    )


def gb_months(by_day: DataFrame) -> DataFrame:
    """(bucket, gb_months, peak): each day is its share of its own month."""
    share = F.col("bytes") / F.dayofmonth(F.last_day("day")) / 1e9
    return by_day.groupBy("bucket").agg(F.sum(share).alias("gb_months"), F.max("peak").alias("peak"))


def with_team(names: DataFrame, teams: DataFrame) -> DataFrame:
    """``names`` (bucket, ...) with team and named_by_two: the first team (by name) that names the bucket, else the longest prefix.

    teams: (name, members array, prefixes array). Prefixes are met by equality: a bucket that no team names is cut to each length that a
    prefix has, and the cuts are joined with the prefixes. A table of teams has few lengths, as names have at most 63 characters.
    """
    exact = teams.select(F.explode("members").alias("bucket"), "name").groupBy("bucket").agg(F.min("name").alias("exact"), (F.count("*") > 1).alias("named_by_two"))
    named = names.join(exact, "bucket", "left")
    prefixes = teams.select(F.explode("prefixes").alias("prefix"), "name").groupBy("prefix").agg(F.min("name").alias("by_prefix"))
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    cuts = F.array(*[F.substring("bucket", 1, n) for n in lengths]).cast("array<string>")
    cut = named.filter("exact IS NULL").select("bucket").distinct().select("bucket", F.explode(F.array_distinct(cuts)).alias("prefix"))
    best = cut.join(prefixes, "prefix").groupBy("bucket").agg(F.max_by("by_prefix", F.length("prefix")).alias("by_prefix"))
    return named.join(best, "bucket", "left").select(*names.columns, F.coalesce("exact", "by_prefix").alias("team"), F.coalesce("named_by_two", F.lit(False)).alias("named_by_two"))


def compliance_report(config: DataFrame, counts: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Each bucket's versioning, lock and encryption state beside its ``compliance_counts``; those are NULL for a bucket not counted yet.

    config: (bucket, versioning, locked, encryption); lifecycle: (bucket, enabled, expires) by rule. lifecycle_expires tells whether
    an enabled rule expires something.
    """
    expiring = lifecycle.groupBy("bucket").agg(F.bool_or(F.col("enabled") & F.col("expires")).alias("lifecycle_expires"))
    state = config.select("bucket", F.coalesce("versioning", F.lit("Off")).alias("versioning"), F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("encryption", F.lit("none")).alias("encryption"))
    return state.join(expiring, "bucket", "left").join(counts, "bucket", "left").withColumn("lifecycle_expires", F.coalesce("lifecycle_expires", F.lit(False)))


def usage_report(by_bucket_day: DataFrame, traffic: DataFrame) -> DataFrame:
    """Storage and traffic of each bucket over a period; a side without rows counts as 0."""
    stored = gb_months(by_bucket_day)
    moved = traffic.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in ("data_in", "data_out", "read", "write", "delete")])
    zero = {"gb_months": 0.0} | {x: 0 for x in ("data_in", "data_out", "read", "write", "delete")}
    return stored.join(moved, "bucket", "full").fillna(zero)


def cost(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """``usage_report`` rows with their cost; a rate that is not given is 0."""
    gb = 1e9
    terms = [("gb_months", "storageGbMonth", 1), ("data_out", "outGb", gb), ("data_in", "inGb", gb), ("read", "per10kRead", 1e4), ("write", "per10kWrite", 1e4), ("delete", "per10kDelete", 1e4)]
    return usage.withColumn("cost", sum((F.col(c) / unit * float(rates.get(r, 0)) for c, r, unit in terms), F.lit(0.0)))


def quota_exceeded(used: Column, size: Column, limit: Column) -> Column:
    """A hard quota: the object alone reaches it, or together with what is there."""
    return (size >= limit) | ((used > 0) & (used + size >= limit))


def kept_segments(segments: DataFrame, today: str, max_age: int, max_bytes: int) -> DataFrame:
    """Segments (day, bytes) that stay, with the running bytes: young enough, and whole days from the newest on until the bytes reach the limit.

    Only the days' sums, ``max_age`` + 1 at most, are put in one order.
    """
    newest = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    young = segments.filter(F.datediff(F.lit(today).cast("date"), "day").between(0, max_age))
    days = young.groupBy("day").agg(F.sum("bytes").alias("running")).withColumn("running", F.sum("running").over(newest))
    return young.join(days.filter(F.col("running") <= max_bytes), "day")


DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def parse_day(text: Column) -> Column:
    """A day as YYYY-MM-DD; NULL if it is no day."""
    return F.when(text.rlike(DAY), text.try_cast("date"))


def period(first: str, last: str, most: int = 400) -> tuple[dt.date, dt.date]:
    """The days of a period, or an error: both must be days, and there are from 1 to ``most``."""
    try:
        if not (re.match(DAY, first) and re.match(DAY, last)):
            raise ValueError
        a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    except ValueError:
        raise ValueError("from and to are days, as YYYY-MM-DD") from None
    if not 0 <= (b - a).days < most:
        raise ValueError(f"the period is from 1 to {most} days, from before to")
    return a, b


def retained_since(today: Column, keep: int) -> Column:
    """The first day that ``keep`` days of history hold."""
    return F.date_sub(today, keep - 1)
