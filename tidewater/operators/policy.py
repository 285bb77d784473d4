"""Access policies: conditions, decisions on requests, and what principals may do.

Statements are configuration and become conditions of the plan. Requests: action, bucket, object, principal, context (a map
from condition keys to arrays of values).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import in_cidr, wildcard

Test = tuple[str, str, tuple]  # operator, key, values


@dataclass(frozen=True)
class Statement:
    effect: str
    actions: tuple[str, ...] = ("*",)
    not_actions: tuple[str, ...] = ()
    resources: tuple[str, ...] = ("*",)
    conditions: tuple[Test, ...] = ()
    principals: tuple[str, ...] = field(default=("*",))


def lookup(context: Column, key: str) -> Column:
    """A condition key's values: by the canonical header form, then by the plain name."""
    plain = key.split(":")[-1]
    header = "-".join(p.capitalize() for p in plain.split("-"))
    return F.coalesce(context[header], context[plain])


def _any(values: tuple, test) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return F.coalesce(out, F.lit(False))


def condition(context: Column, op: str, key: str, values: tuple) -> Column:
    """One test of a statement, never NULL. ``ForAllValues:`` holds for no values, ``ForAnyValue:`` does not."""
    every = op.startswith("ForAllValues:")
    op = op.split(":")[-1]
    if_exists = op.endswith("IfExists")
    op = op.removesuffix("IfExists")
    found = lookup(context, key)
    there = F.coalesce(F.size(found) > 0, F.lit(False))
    first = F.get(found, F.lit(0))
    absent = F.lit(if_exists)
    if op == "Null":
        return (~there) if str(values[0]).lower() == "true" else there
    if op == "Bool":
        return F.when(there, F.lower(first) == str(values[0]).lower()).otherwise(False)
    if op in ("IpAddress", "NotIpAddress"):
        inside = _any(values, lambda v: in_cidr(first, v))
        return F.when(there, inside if op == "IpAddress" else ~inside).otherwise(absent)
    if op.startswith("Numeric") or op.startswith("Date"):
        kind, name = ("bigint", op[7:]) if op.startswith("Numeric") else ("timestamp", op[4:])
        x = first.try_cast(kind)
        compare = {
            "Equals": lambda v: x == v, "NotEquals": lambda v: x != v, "LessThan": lambda v: x < v, "LessThanEquals": lambda v: x <= v,
            "GreaterThan": lambda v: x > v, "GreaterThanEquals": lambda v: x >= v,
        }[name]
        return F.when(there, _any(values, lambda v: compare(F.lit(v).cast(kind)))).otherwise(absent)
    negative = "Not" in op
    fold = (lambda c: F.lower(c)) if "IgnoreCase" in op else (lambda c: c)
    if "Like" in op:
        one = lambda x: _any(values, lambda v: wildcard(x, v))
    else:
        one = lambda x: fold(x).isin(*[v.lower() if "IgnoreCase" in op else v for v in values])
    hit = F.forall(found, one) if every else F.exists(found, one)
    hit = F.when(there, F.coalesce(hit, F.lit(False))).otherwise(every)
    return ~hit if negative else hit


def applies(s: Statement) -> Column:
    """Whether a statement is about a request: principal, action, resource and all conditions."""
    action, context = F.col("action"), F.col("context")
    resource = F.concat_ws("/", "bucket", "object")
    test = _any(s.actions, lambda p: wildcard(action, p)) if not s.not_actions else ~_any(s.not_actions, lambda p: wildcard(action, p))
    test = test & _any(s.resources, lambda p: wildcard(resource, p)) & _any(s.principals, lambda p: wildcard(F.col("principal"), p))
    for op, key, values in s.conditions:
        test = test & condition(context, op, key, values)
    return test


def allowed(statements: list[Statement], owner: Column | None = None) -> Column:
    """An explicit deny wins, then an allow; nothing is a no. The owner is held back by denials alone."""
    deny, allow = F.lit(False), owner if owner is not None else F.lit(False)
    for s in statements:
        if s.effect == "Deny":
            deny = deny | applies(s)
        else:
            allow = allow | applies(s)
    return ~deny & allow


#: Access levels and the actions that stand for them.
LEVELS = {"read": "s3:GetObject", "write": "s3:PutObject", "delete": "s3:DeleteObject", "manage": "s3:PutBucketPolicy"}


FLAGS = ("d", "md", "a", "ma")


def _flags(grants: DataFrame, holder: str) -> DataFrame:
    """What a holder's grants of an action come to: a certain or possible deny, a certain or possible allow."""
    deny, sure = F.col("effect") == "Deny", F.col("certain")
    tests = (deny & sure, deny & ~sure, ~deny & sure, ~deny & ~sure)
    return grants.groupBy(holder, "action").agg(*[F.bool_or(t).alias(n) for t, n in zip(tests, FLAGS, strict=True)])


def _decision() -> Column:
    return F.when(F.col("d"), "denied").when(F.col("a"), F.when(F.col("md"), "conditional").otherwise("allowed")).when(F.col("ma"), "conditional").otherwise("none").alias("decision")


def decide(grants: DataFrame) -> DataFrame:
    """(principal, action, decision) from (principal, action, effect, certain).

    A certain deny is denied; an allow is allowed, or conditional if a deny may match; an allow that only may match is conditional; else none.
    """
    return _flags(grants, "principal").select("principal", "action", _decision())


def access_review(principals: DataFrame, memberships: DataFrame, grants: DataFrame, salts: int = 64) -> DataFrame:
    """(principal, action, decision): a principal's own grants, those it has as a member and those to everyone.

    principals (principal), memberships (principal, member_of), grants (holder, action, effect, certain); holder ``*`` is everyone.
    Grants come down to a row for each holder and action first. What everyone has is dealt over ``salts`` keys.
    """
    flags = _flags(grants, "holder")
    own = principals.select("principal", F.col("principal").alias("holder"))
    as_member = principals.join(memberships, "principal").select("principal", F.col("member_of").alias("holder"))
    held = own.unionByName(as_member).distinct().join(flags.filter("holder <> '*'"), "holder").drop("holder")
    star = flags.filter("holder = '*'").drop("holder").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    everyone = principals.distinct().withColumn("salt", F.pmod(F.hash("principal"), F.lit(salts))).join(star, "salt").drop("salt")
    return held.unionByName(everyone.select(held.columns)).groupBy("principal", "action").agg(*[F.bool_or(f).alias(f) for f in FLAGS]).select("principal", "action", _decision())
