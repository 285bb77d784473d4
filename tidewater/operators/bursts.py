"""Bursts of deletes and overwrites: sliding counts, the usual level, detection, contributors, incidents.

Counters: (ts, bucket, access_key, kind, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("deleted", "destroyed", "overwritten")


def recent(counters: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """(bucket, access_key, kind, n): sums over the last ``minutes`` minute slots, the current one included."""
    slot, last = F.date_trunc("minute", "ts"), F.date_trunc("minute", now)
    inside = (slot > last - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (slot <= last)
    return counters.filter(inside).groupBy("bucket", "access_key", "kind").agg(F.sum("n").alias("n"))


def sliding(counters: DataFrame, minutes: int = 5) -> DataFrame:
    """(start, bucket, kind, n) for every window of ``minutes`` that slides by a minute; also for streams."""
    window = F.window("ts", f"{minutes} minutes", "1 minute")
    return counters.groupBy(window.alias("w"), "bucket", "kind").agg(F.sum("n").alias("n")).select(F.col("w.start").alias("start"), "bucket", "kind", "n")


def usual(history: DataFrame, days: int = 14, minutes: int = 5) -> DataFrame:
    """(bucket, kind, usual) from hourly history (day 0 to days-1, bucket, kind, hour, n).

    The upper median of the days' busiest hours, days without a record counting 0, scaled to the window and rounded up.
    """
    hours = history.filter(F.col("day").between(0, days - 1)).groupBy("bucket", "kind", "day", "hour").agg(F.sum("n").alias("n"))
    top = hours.groupBy("bucket", "kind", "day").agg(F.max("n").alias("n"))
    sorted_tops = F.sort_array(F.collect_list("n"))  # at most one value for each of the days
    lists = top.groupBy("bucket", "kind").agg(sorted_tops.alias("tops"))
    place = F.lit(days // 2 - days) + F.size("tops")  # zeros fill up in front
    median = F.when(place >= 0, F.get("tops", place)).otherwise(0)
    return lists.select("bucket", "kind", F.ceil(median * minutes / F.lit(60.0)).alias("usual"))


def _top3(*keys: str) -> tuple[Window, Column]:
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "access_key")
    return order, F.row_number().over(order) <= 3


def contributors(counts: DataFrame, *keys: str) -> DataFrame:
    """The three rows of the largest n for each key, ties to the smaller access key."""
    _, first = _top3(*keys)
    return counts.filter(F.col("n") > 0).withColumn("_first", first).filter("_first").drop("_first")


def bucket_bursts(counts: DataFrame, level: DataFrame, floor: int = 1000, factor: float = 10, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, kind, n, usual, who): each bucket whose count reaches the floor and ``factor`` times the usual."""
    counts = counts.filter(~F.col("bucket").isin(*excluded)) if excluded else counts
    sums = counts.groupBy("bucket", "kind").agg(F.sum("n").alias("n")).join(level, ["bucket", "kind"], "left")
    found = sums.withColumn("usual", F.coalesce("usual", F.lit(0))).filter((F.col("n") >= floor) & (F.col("n") > factor * F.col("usual")))
    who = contributors(counts, "bucket", "kind").groupBy("bucket", "kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "access_key"))).alias("w"))
    return found.join(who, ["bucket", "kind"]).select("bucket", "kind", "n", "usual", F.transform("w", lambda x: x["access_key"]).alias("who"))


def credential_bursts(counts: DataFrame, found: DataFrame, level: DataFrame, floor: int = 1000, factor: float = 10) -> DataFrame:
    """(access_key, kind, n, n_named): credentials over at least two names of bucket that no burst in ``found`` names yet."""
    sums = counts.join(level, ["bucket", "kind"], "left").groupBy("access_key", "kind").agg(
        F.sum("n").alias("n"), F.count_distinct("bucket").alias("n_named"), F.sum(F.coalesce("usual", F.lit(0))).alias("usual")
    )
    hot = sums.filter((F.col("n_named") >= 2) & (F.col("n") >= floor) & (F.col("n") > factor * F.col("usual")))
    named = found.select("kind", F.explode("who").alias("access_key")).distinct()
    return hot.join(named, ["kind", "access_key"], "left_anti").select("access_key", "kind", "n", "n_named")


def incidents(bursts: DataFrame, quiet: str = "15 minutes") -> DataFrame:
    """Bursts (ts, bucket, kind, n) of one bucket and kind as incidents that a quiet time closes; also for streams.

    opened and closes are aggregates of ts and not the session's bounds: Spark moves a filter on those below the aggregate, where it cuts incidents.
    """
    session = F.session_window("ts", quiet)
    closes = F.max("ts") + F.lit(quiet).cast("interval")
    found = bursts.groupBy(session.alias("s"), "bucket", "kind").agg(F.min("ts").alias("opened"), closes.alias("closes"), F.max("n").alias("peak"), F.count("*").alias("seen"))
    return found.select("opened", "closes", "bucket", "kind", "peak", "seen")


def stored(incidents: DataFrame, now: Column, keep_days: int = 90) -> DataFrame:
    """Incidents (opened, closes, bucket, kind, peak, ...) as they are stored at ``now``: with closed, NULL while they are open.

    Those that closed more than ``keep_days`` ago are gone, and those that open later aren't there yet.
    """
    closed = F.when(F.col("closes") <= now, F.col("closes"))
    kept = closed.isNull() | (closed >= now - F.make_dt_interval(F.lit(keep_days)))
    return incidents.withColumn("closed", closed).filter((F.col("opened") <= now) & kept)


def recorded(stored: DataFrame, bursts: DataFrame, now: Column, quiet_minutes: int = 15, keep_days: int = 90) -> DataFrame:
    """The store of incidents (bucket, kind, opened, last_seen, closed, peak) after the bursts (bucket, kind, n) of ``now``.

    A burst goes on with the open incident of its bucket and kind, raising the peak, or opens one. Open ones that were not seen for
    ``quiet_minutes`` close; those closed for over ``keep_days`` go.
    """
    keys = ["bucket", "kind"]
    seen = bursts.groupBy(*keys).agg(F.max("n").alias("n"))
    running = stored.filter("closed IS NULL").join(seen, keys, "full")
    at = F.when(F.col("n").isNotNull(), now).otherwise(F.col("last_seen"))
    running = running.select(*keys, F.coalesce("opened", now).alias("opened"), at.alias("last_seen"), "closed", F.greatest("peak", "n").alias("peak"))
    quiet = running.withColumn("closed", F.when(F.col("last_seen") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(quiet_minutes)), now))
    old = stored.filter(F.col("closed") >= now - F.make_dt_interval(F.lit(keep_days)))
    return quiet.unionByName(old.select(quiet.columns))


def listed(stored: DataFrame, open_only: bool = False) -> DataFrame:
    """Stored incidents, newest first."""
    out = stored.filter("closed IS NULL") if open_only else stored
    return out.orderBy(F.desc("opened"), "bucket", "kind")
