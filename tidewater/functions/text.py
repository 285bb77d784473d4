"""Small text functions: wildcards, addresses, sizes, durations, tags, size classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard(s: Column, pattern: str) -> Column:
    """``*`` stands for any text, ``?`` for one character."""
    if "*" not in pattern and "?" not in pattern:
        return s == pattern
    return s.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address (also one mapped into IPv6) as a number; NULL if it is none."""
    plain = F.regexp_replace(ip, "^::ffff:", "")
    parts = F.split(plain, r"\.")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    valid = plain.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(valid, part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * 256 + part(3))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address is in a block; what can't be parsed is in none."""
    base, _, bits = cidr.partition("/")
    number = 0
    for x in base.split("."):
        number = number * 256 + int(x)
    low = number & (~((1 << (32 - int(bits or 32))) - 1))
    x = ipv4_number(ip)
    return F.coalesce((x >= low) & (x < low + (1 << (32 - int(bits or 32)))), F.lit(False))


# Units of sizes and durations.
BYTES = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}
NANOS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def parse_bytes(s: Column) -> Column:
    """``10MiB``, ``5 MB`` or ``1,000`` in bytes; NULL if it can't be read."""
    shape = r"^\s*([0-9][0-9,]*\.?[0-9]*)\s*([A-Za-z]*)\s*$"
    number = F.regexp_replace(F.regexp_extract(s, shape, 1), ",", "").try_cast("double")
    return (number * _map(BYTES)[F.lower(F.regexp_extract(s, shape, 2))]).cast("bigint")


def parse_duration(s: Column) -> Column:
    """Durations such as ``1h30m`` or ``7d`` in nanoseconds; NULL if it can't be read."""
    term = r"([0-9]+\.?[0-9]*)(ns|us|ms|s|m|h|d|w)"
    numbers = F.regexp_extract_all(s, F.lit(term), F.lit(1))
    units = F.regexp_extract_all(s, F.lit(term), F.lit(2))
    each = F.zip_with(numbers, units, lambda n, u: (n.cast("double") * _map(NANOS)[u]).cast("bigint"))
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(s == "0", F.lit(0).cast("bigint")).when(s.rlike(f"^[+-]?({term})+$"), F.when(s.startswith("-"), -total).otherwise(total))


def parse_tags(s: Column) -> Column:
    """``k=v&k2=v2``, URL-encoded, as a map."""
    pairs = F.filter(F.split(s, "&"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise("")))))


# Size classes of replicated objects.
SIZE_TAGS = [("LESS_THAN_1_KiB", 2**10), ("LESS_THAN_1_MiB", 2**20), ("LESS_THAN_10_MiB", 10 * 2**20), ("LESS_THAN_100_MiB", 100 * 2**20), ("LESS_THAN_1_GiB", 2**30)]


def size_tag(size: Column) -> Column:
    out = F.lit("GREATER_THAN_1_GiB")
    for name, limit in reversed(SIZE_TAGS):
        out = F.when(size < limit, name).otherwise(out)
    return out
