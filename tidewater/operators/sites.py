"""Comparisons over nodes and sites: locks, directory sync, replicated entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_locks(dumps: DataFrame, quorum: int, stale: bool = False, n: int = 10) -> DataFrame:
    """Lock dumps (server, resource, uid, since) of all nodes by lock: held by a quorum unless ``stale``, oldest first; n <= 0 is all."""
    locks = dumps.groupBy("resource", "uid").agg(F.min("since").alias("since"), F.count_distinct("server").alias("n_servers"), F.array_sort(F.collect_set("server")).alias("servers"))
    kept = locks if stale else locks.filter(F.col("n_servers") >= quorum)
    ordered = kept.orderBy("since", "resource", "uid")
    return ordered.limit(n) if n > 0 else ordered


def sync_plan(credentials: DataFrame, directory: DataFrame, held: DataFrame, most_leaving: int) -> DataFrame:
    """(credential, action, stopped) from credentials (credential, person), directory (person, active) and held (credential).

    A person who left has credentials suspended, one who is back has held ones resumed, and held credentials that exist no
    more are forgotten. The plan is stopped as a whole if more than ``most_leaving`` people would leave.
    """
    known = credentials.join(directory, "person", "left").join(held.withColumn("is_held", F.lit(True)), "credential", "left")
    here, on_hold = F.coalesce("active", F.lit(False)), F.coalesce("is_held", F.lit(False))
    action = F.when(~here & ~on_hold, "suspend").when(here & on_hold, "resume").otherwise("keep")
    actions = known.select("credential", "person", action.alias("action"))
    gone = held.join(credentials, "credential", "left_anti").select("credential", F.lit(None).cast("string").alias("person"), F.lit("forget").alias("action"))
    plan = actions.unionByName(gone)
    leaving = plan.agg((F.count_distinct(F.when(F.col("action") == "suspend", F.col("person"))) > most_leaving).alias("stopped"))
    return plan.join(F.broadcast(leaving), how="left").select("credential", "action", "stopped")


def site_status(entities: DataFrame, n_sites: int) -> DataFrame:
    """(entity, n_present, replicated): whether every site has the entity with an equal value; entities (site, entity, value)."""
    return entities.groupBy("entity").agg(
        F.count_distinct("site").alias("n_present"), ((F.count_distinct("site") == n_sites) & (F.count_distinct("value") == 1) & (F.count_if(F.col("value").isNull()) == 0)).alias("replicated")
    )
