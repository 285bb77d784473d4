"""Rules against objects: lifecycle, replication, notification, batch jobs, retention of versions.

Rule sets are configuration: a rule becomes a condition that is built into the plan, so matching is a filter over one scan of the
versions, without a join or a cross product. Where a rule's own columns are needed afterwards, the matching rules are an
array that is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import wildcard


@dataclass(frozen=True)
class LifecycleRule:
    id: str
    prefix: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    size_gt: int | None = None
    size_lt: int | None = None
    days: int | None = None
    noncurrent_days: int | None = None
    newer_noncurrent: int = 0
    marker_days: int | None = None
    transition_days: int | None = None
    enabled: bool = True


def expected_expiry(mod_time: Column, days: int) -> Column:
    """Midnight after ``days`` whole days; 0 days is the time itself."""
    return mod_time if days == 0 else F.date_trunc("day", mod_time + F.make_dt_interval(F.lit(days + 1)))


def lifecycle_matches(rule: LifecycleRule) -> Column:
    """Prefix, all tags, and sizes strictly between the limits; delete markers skip the sizes."""
    test = F.lit(rule.enabled) & F.col("key").startswith(rule.prefix)
    for k, v in rule.tags.items():
        test = test & F.coalesce(F.col("tags")[k] == v, F.lit(False))
    for limit, op in ((rule.size_gt, lambda s, x: s > x), (rule.size_lt, lambda s, x: s < x)):
        if limit is not None:
            test = test & (F.col("delete_marker") | op(F.col("size"), limit))
    return test


def lifecycle_events(versions: DataFrame, rules: list[LifecycleRule], now: Column) -> DataFrame:
    """The winning event of each version that has one: rule, action and due.

    versions: key, version_id, mod_time, size, tags, delete_marker, is_latest, successor_time, num_versions. Of the
    events that are due, deletes come before transitions and then the earliest; else the earliest to come.
    """
    latest, marker = F.col("is_latest"), F.col("delete_marker")
    events = []
    for r in rules:
        match = lifecycle_matches(r)
        cases = [
            (r.days, "delete", latest & ~marker, F.col("mod_time")),
            (r.noncurrent_days, "delete_version", ~latest & F.col("successor_time").isNotNull(), F.col("successor_time")),
            (r.marker_days, "delete_marker", latest & marker & (F.col("num_versions") == 1), F.col("mod_time")),
            (r.transition_days, "transition", latest & ~marker, F.col("mod_time")),
        ]
        for days, action, when, since in cases:
            if days is not None:
                due = expected_expiry(since, days)
                # Ordered by: not yet due, not a delete (among the due), due.
                rank = F.struct((due > now).alias("later"), F.when(due > now, False).otherwise(F.lit(action == "transition")).alias("soft"), due.alias("due"), F.lit(r.id).alias("rule"), F.lit(action).alias("action"))
                events.append(F.when(match & when, rank))
    best = F.array_min(F.filter(F.array(*events), lambda e: e.isNotNull()))
    return versions.withColumn("event", best).filter(F.col("event").isNotNull()).select("key", "version_id", "size", "event.rule", "event.action", "event.due")


def noncurrent_kept(versions: DataFrame, days: int, newer: int, now: Column) -> DataFrame:
    """(key, version_id, deleted): noncurrent versions whose clock has run out go, but the newest ``newer`` stay.

    versions: key, version_id, mod_time, is_latest, successor_time, locked. The rule is a count of what was kept, from new
    to old: a due, unlocked noncurrent version is deleted once ``newer`` noncurrent ones were kept. Before the count is
    reached nothing is deleted, and afterwards it stays reached. So it is reached when ``newer`` noncurrent versions
    come before, whatever became of them, and a running count does without a list of a key's versions.
    """
    due = F.coalesce(expected_expiry(F.col("successor_time"), days) <= now, F.lit(False))
    newest = Window.partitionBy("key").orderBy(F.desc("mod_time"), F.desc("version_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("is_latest"), 0).otherwise(1)).over(newest), F.lit(0))
    deleted = ~F.col("is_latest") & due & ~F.col("locked") & (before >= newer)
    return versions.select("key", "version_id", deleted.alias("deleted"))


def lifecycle_preview(events: DataFrame, now: Column, horizons: list[int]) -> DataFrame:
    """(rule, action, horizon, objects, bytes, examples): each version at the first horizon (days) by which it is due; up to 3 keys."""
    horizon = F.coalesce(*[F.when(F.col("due") <= now + F.make_dt_interval(F.lit(h)), h) for h in sorted(horizons)])
    rows = events.withColumn("horizon", horizon).filter(F.col("horizon").isNotNull())
    by_key = rows.groupBy("rule", "action", "horizon", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    first = by_key.withColumn("place", F.row_number().over(Window.partitionBy("rule", "action", "horizon").orderBy("key")))
    return first.groupBy("rule", "action", "horizon").agg(
        F.sum("n").alias("objects"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("key")))).alias("examples")
    )


@dataclass(frozen=True)
class ReplicationRule:
    id: str
    destination: str
    priority: int
    prefix: str = ""
    tags: dict[str, str] = field(default_factory=dict)


def replication_targets(objects: DataFrame, rules: list[ReplicationRule]) -> DataFrame:
    """(key, destination, rule): for each destination the matching rule of the highest priority. Any one tag is enough."""
    found = []
    for r in rules:
        test = F.col("key").startswith(r.prefix)
        if r.tags:
            any_tag = F.lit(False)
            for k, v in r.tags.items():
                any_tag = any_tag | F.coalesce(F.col("tags")[k] == v, F.lit(False))
            test = test & any_tag
        found.append(F.when(test, F.struct(F.lit(r.destination).alias("destination"), F.lit(-r.priority).alias("p"), F.lit(r.id).alias("rule"))))
    hits = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    # Sorted by destination and falling priority: the first of each destination wins.
    winners = F.filter(hits, lambda x, i: (i == 0) | (F.get(hits, i - 1)["destination"] != x["destination"]))
    return objects.select("key", F.explode(winners).alias("w")).select("key", "w.destination", "w.rule")


@dataclass(frozen=True)
class Queue:
    target: str
    events: tuple[str, ...]
    prefix: str = ""
    suffix: str = ""


def notified(events: DataFrame, queues: list[Queue]) -> DataFrame:
    """(*, target): an event's distinct targets, by its name and ``prefix*suffix`` over its key."""
    hits = [
        F.when(F.col("event").isin(*q.events) & wildcard(F.col("key"), f"{q.prefix}*{q.suffix}"), F.lit(q.target)) for q in queues
    ]
    return events.withColumn("target", F.explode(F.array_distinct(F.filter(F.array(*hits), lambda t: t.isNotNull()))))


def beyond_newest(versions: DataFrame, latest_matches: Column, keep: int) -> DataFrame:
    """Versions of (bucket, key) beyond the newest ``keep``, where the latest version matches; 0 is the whole key."""
    newest = Window.partitionBy("bucket", "key").orderBy(F.desc("mod_time"), F.desc("version_id"))
    ranked = versions.withColumn("_n", F.row_number().over(newest)).withColumn("_m", F.first(latest_matches).over(newest))
    return ranked.filter(F.col("_m") & (F.col("_n") > keep)).drop("_n", "_m")


def expires(now: Column, name: str = "*", older_than: Column | None = None, created_before: Column | None = None, tags: dict | None = None, meta: dict | None = None, size_le: int | None = None, size_ge: int | None = None) -> Column:
    """A batch expiry filter: all tags, all metadata, sizes inclusive, older than (strictly) and created before."""
    test = wildcard(F.col("key"), name)
    if older_than is not None:
        test = test & (F.col("mod_time") < now - older_than)
    if created_before is not None:
        test = test & (F.col("mod_time") < created_before)
    for column, wanted in (("tags", tags), ("meta", meta)):
        for k, v in (wanted or {}).items():
            test = test & F.coalesce(wildcard(F.col(column)[k], v), F.lit(False))
    if size_le is not None:
        test = test & (F.col("size") <= size_le)
    if size_ge is not None:
        test = test & (F.col("size") >= size_ge)
    return test


def pushes(now: Column, older_than: Column | None = None, newer_than: Column | None = None, created_after: Column | None = None, created_before: Column | None = None, tags: dict | None = None) -> Column:
    """A batch replication filter: at least as old, newer, created in between, and any tag."""
    test = F.lit(True)
    if older_than is not None:
        test = test & (F.col("mod_time") <= now - older_than)
    if newer_than is not None:
        test = test & (F.col("mod_time") > now - newer_than)
    if created_after is not None:
        test = test & (F.col("mod_time") >= created_after)
    if created_before is not None:
        test = test & (F.col("mod_time") <= created_before)
    if tags:
        test = test & any_of("tags", tags)
    return test


def any_of(column: str, wanted: dict[str, str]) -> Column:
    """Whether any of the wanted pairs is in a map column."""
    test = F.lit(False)
    for k, v in wanted.items():
        test = test | F.coalesce(wildcard(F.col(column)[k], v), F.lit(False))
    return test
