"""Audit entries: filters, newest first with a cursor, merged over nodes.

Entries: time, api struct (name, bucket, object, objects array, statusCode), accessKey, parentUser, requestClaims map, remotehost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.usage import api_kind


def status_class(code: Column) -> Column:
    return F.when(code.isin(401, 403), "denied").when(code >= 400, "failed").otherwise("ok")


def matches(start=None, end=None, before=None, user=None, access_key=None, bucket=None, prefix=None, api=None, kind=None, status=None, ip=None) -> Column:
    """The filter of a search; what is not given is not tested. Bounds on time go down to the scan's partitions."""
    c = F.col
    tests: list[Column] = []
    if start is not None:
        tests.append(c("time") >= start)
    if end is not None:
        tests.append(c("time") <= end)
    if before is not None:
        tests.append(c("time") < before)
    if user is not None:
        name = F.when(F.coalesce(c("parentUser"), F.lit("")) != "", c("parentUser")).otherwise(c("accessKey"))
        claims = F.array(*[c("requestClaims")[k] for k in ("preferred_username", "upn", "email")])
        tests.append((name == user) | F.coalesce(F.exists(claims, lambda x: x.eqNullSafe(F.lit(user))), F.lit(False)))
    if access_key is not None:
        tests.append(c("accessKey") == access_key)
    if bucket is not None:
        tests.append(c("api.bucket") == bucket)
    if prefix is not None:
        listed = F.exists(c("api.objects"), lambda o: o.startswith(prefix))
        tests.append(F.coalesce(c("api.object").startswith(prefix), F.lit(False)) | F.coalesce(listed, F.lit(False)))
    if api is not None:
        tests.append(F.lower("api.name") == api.lower())
    if kind is not None:
        tests.append(api_kind(F.lower("api.name")) == kind)
    if status is not None:
        tests.append(status_class(c("api.statusCode")) == status)
    if ip is not None:
        tests.append(c("remotehost").startswith(ip))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def newest(entries: DataFrame, n: int = 100, before: Column | None = None) -> DataFrame:
    """The newest ``n`` (1000 at most) strictly before a cursor: each task's newest, then theirs."""
    rows = entries if before is None else entries.filter(F.col("time") < before)
    return rows.orderBy(F.desc("time")).limit(min(n, 1000))


def merged(*nodes: DataFrame) -> DataFrame:
    """The entries of all nodes."""
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n, allowMissingColumns=True)
    return out
