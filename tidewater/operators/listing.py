"""Listings of objects and versions: prefix, delimiter, markers and pages, and the order of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import parse_tags


def with_version_order(versions: DataFrame, key: list[str]) -> DataFrame:
    """Adds is_latest, successor_time (of the next newer version) and num_versions, newest first within a key."""
    newest = Window.partitionBy(*key).orderBy(F.desc("mod_time"), F.desc("version_id"))
    return versions.withColumns(
        {
            "is_latest": F.row_number().over(newest) == 1,
            "successor_time": F.lag("mod_time").over(newest),
            "num_versions": F.count("*").over(Window.partitionBy(*key)),
        }
    )


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to and with the first delimiter after the prefix; NULL if there is none."""
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substr(key, F.lit(1), at + len(delimiter) - 1))


def list_page(objects: DataFrame, prefix: str = "", delimiter: str = "", marker: str = "", max_keys: int = 1000, key: str = "key") -> DataFrame:
    """One page: (entry, is_prefix), bytewise order, objects and common prefixes sharing ``max_keys``.

    Prefix and marker go down to the scan. Common prefixes fold in a partial aggregate, and the page is a top-n of each
    task's entries. One more row than ``max_keys`` comes back if the listing goes on (``truncated``). A marker inside a
    common prefix skips that prefix.
    """
    k = F.col(key)
    rows = objects.filter(k.startswith(prefix) & (k > marker) if marker else k.startswith(prefix))
    folded = common_prefix(k, prefix, delimiter) if delimiter else F.lit(None).cast("string")
    entries = rows.select(F.coalesce(folded, k).alias("entry"), folded.isNotNull().alias("is_prefix"))
    if delimiter and marker.startswith(prefix) and (at := marker.find(delimiter, len(prefix))) >= 0:
        entries = entries.filter(~(F.col("is_prefix") & (F.col("entry") == marker[: at + len(delimiter)])))
    top = entries.distinct().orderBy("entry").limit(max_keys + 1)
    return top.withColumn("truncated", F.count("*").over(Window.partitionBy()) > max_keys).orderBy("entry").limit(max_keys) if max_keys else top.limit(0)


def list_versions(versions: DataFrame, key_marker: str = "", version_marker: int | None = None, max_keys: int = 1000) -> DataFrame:
    """Versions by key, newest first within a key, after the markers (inside a key if a version is given).

    The marker goes down to the scan. The page's keys come from a top-n, and only their versions are put in order.
    """
    key, inside = F.col("key"), bool(key_marker) and version_marker is not None
    rows = versions.filter(key >= key_marker if inside else key > key_marker) if key_marker else versions
    # A key more than the page has rows: the marker's own key may have no version left.
    keys = rows.select("key").distinct().orderBy("key").limit(max_keys + 1)
    ordered = with_version_order(rows.join(keys, "key", "left_semi"), ["key"])
    if inside:
        at = versions.filter((key == key_marker) & (F.col("version_id") == version_marker)).agg(F.max("mod_time").alias("at")).first()["at"]
        older = F.lit(False) if at is None else (F.col("mod_time") < F.lit(at)) | ((F.col("mod_time") == F.lit(at)) & (F.col("version_id") < version_marker))
        ordered = ordered.filter((key > key_marker) | older)
    return ordered.orderBy("key", F.desc("mod_time"), F.desc("version_id")).limit(max_keys)


def list_bucket(names: DataFrame, allowed: DataFrame) -> DataFrame:
    """The names (bucket) in order, of those that the caller may see (bucket)."""
    return names.select("bucket").distinct().join(allowed.select("bucket").distinct(), "bucket", "left_semi").orderBy("bucket")


def with_metadata(objects: DataFrame, internal: str = "x-internal", tagging: str = "x-tagging") -> DataFrame:
    """Objects (..., metadata map, data_blocks, parity_blocks) as a listing with metadata shows them: metadata, tags and the erasure code.

    Keys that begin with ``internal`` are left out; that of the tags becomes the map ``tags``; ec is ``data+parity``.
    """
    m = F.col("metadata")
    tags = F.coalesce(parse_tags(F.try_element_at(m, F.lit(tagging))), F.create_map().cast("map<string,string>"))
    shown = F.map_filter(m, lambda k, v: ~k.startswith(internal) & (k != tagging))
    ec = F.concat(F.col("data_blocks").cast("string"), F.lit("+"), F.col("parity_blocks").cast("string"))
    return objects.withColumns({"metadata": shown, "tags": tags, "ec": ec}).drop("data_blocks", "parity_blocks")


def list_uploads(uploads: DataFrame, prefix: str = "", key_marker: str = "", upload_marker: str | None = None, max_uploads: int = 1000) -> DataFrame:
    """Open uploads (key, upload_id, initiated) of a prefix after the markers, oldest first."""
    rows = uploads.filter(F.col("key").startswith(prefix)) if prefix else uploads
    if key_marker:
        later = F.col("key") > key_marker
        rows = rows.filter(later if upload_marker is None else later | ((F.col("key") == key_marker) & (F.col("upload_id") > upload_marker)))
    return rows.orderBy("initiated", "upload_id").limit(max_uploads)


def list_parts(parts: DataFrame, upload_id: object, part_marker: int = 0, max_parts: int = 10_000) -> DataFrame:
    """The parts (upload_id, part_number, ...) of an upload after the marker, in order; of a part that was sent again the last (mod_time)."""
    rows = parts.filter((F.col("upload_id") == upload_id) & (F.col("part_number") > part_marker))
    last = rows.groupBy("part_number").agg(F.max_by(F.struct(*[c for c in parts.columns if c != "part_number"]), "mod_time").alias("r"))
    return last.select("part_number", "r.*").orderBy("part_number").limit(max_parts)


def merged_pools(*pools: DataFrame, key: str = "key") -> DataFrame:
    """The listings of several pools as one: of a key that several have, the newest."""
    both = pools[0]
    for p in pools[1:]:
        both = both.unionByName(p)
    newest = F.max_by(F.struct(*both.columns), F.struct("mod_time", "version_id"))
    return both.groupBy(F.col(key).alias("_key")).agg(newest.alias("row")).select("row.*")


def latest_state(events: DataFrame, key: str = "key", order: list[str] | None = None, removed: Column | None = None) -> DataFrame:
    """The state view of a stream of events: the last event of each key, but keys whose last event is a removal."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*(order or ["mod_time"]))).alias("row"))
    state = last.select(key, "row.*")
    return state.filter(~removed) if removed is not None else state
