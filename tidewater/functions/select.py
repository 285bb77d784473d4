"""Column builders with the semantics of an S3-Select-style dialect, where these differ from Spark's.

The dialect has two truth values: equality takes NULL for a value, and an ordering with NULL is an error (``strict``) or false.
Numbers of which one is a float are equal within 1e-6. Text that comes untyped from CSV is inferred for each value.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.sources.sinks import float_g

TOLERANCE = 1e-6
INT = r"^\s*[+-]?[0-9]+\s*$"
HEX = r"^\s*([+-]?)0[xX]([0-9a-fA-F_]*)(?:\.([0-9a-fA-F_]*))?[pP]([+-]?[0-9]{1,6})\s*$"
FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# --- comparisons ---------------------------------------------------------------------------------------------------


def eq(a: Column, b: Column) -> Column:
    """Equality in two values: NULL equals NULL and nothing else."""
    return a.eqNullSafe(b)


def eq_float(a: Column, b: Column) -> Column:
    """Equality within 1e-6."""
    return F.coalesce(F.abs(a - b) < TOLERANCE, a.isNull() & b.isNull())


def ne_float(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > TOLERANCE, a.isNull() != b.isNull())


def ordered(a: Column, op: str, b: Column, strict: bool = False) -> Column:
    """``a op b`` for one of < <= > >=; with NULL an error if ``strict``, else false.

    As a filter's own condition a plain comparison keeps the same rows and reaches the scan.
    """
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    null = a.isNull() | b.isNull()
    return F.when(null, F.raise_error(F.lit("cannot order NULL")).cast("boolean") if strict else F.lit(False)).otherwise(found)


def both(*conditions: Column) -> Column:
    """AND that does not look at a term after a false one."""
    return reduce(lambda rest, c: F.when(c, rest).otherwise(False), reversed(conditions), F.lit(True))


def either(*conditions: Column) -> Column:
    """OR that does not look at a term after a true one."""
    return reduce(lambda rest, c: F.when(c, True).otherwise(rest), reversed(conditions), F.lit(False))


def between(x: Column, low: Column, high: Column) -> Column:
    return both(ordered(x, ">=", low), ordered(x, "<=", high))


def in_list(x: Column, values: Column) -> Column:
    """Whether an element of the array equals x, within the tolerance for floats."""
    return F.coalesce(F.exists(values, lambda v: F.abs(v - x) < TOLERANCE), F.lit(False))


def untyped_number(text: Column) -> Column:
    """The number that an untyped text is inferred to be: an int, else a float; NULL if it is neither."""
    return F.when(text.rlike(INT), F.trim(text).try_cast("bigint").cast("double")).when(text.rlike(FLOAT), F.trim(text).try_cast("double"))


def untyped_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False)


def array_eq(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)


def array_ne(a: Column, b: Column) -> Column:
    """Inequality looks at the common beginning alone."""
    n = F.least(F.size(a), F.size(b))
    return F.exists(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ~x.eqNullSafe(y)), lambda differ: differ)


# --- arithmetic ----------------------------------------------------------------------------------------------------


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncates; NULL for a zero divisor (the dialect's error is Spark's under ANSI)."""
    return F.when(b != 0, F.call_function("div", a, b))


def nullif(a: Column, b: Column) -> Column:
    return F.when(~F.coalesce(F.abs(a - b) < TOLERANCE, F.lit(False)), a)


# --- casts ---------------------------------------------------------------------------------------------------------


#: What a number out of the range of integers becomes.
OUT_OF_RANGE = -(1 << 63)


def _or_error(x: Column, text: Column, strict: bool, kind: str) -> Column:
    return F.when(text.isNotNull() & x.isNull(), F.raise_error(F.lit(f"could not parse as {kind}"))).otherwise(x) if strict else x


def hex_float(text: Column) -> Column:
    """The value of ``0x1.8p3`` and its like, with an exponent of two; of over 15 digits the others only count by their place."""
    part = lambda i: F.regexp_extract(text, HEX, i)
    whole, fraction = F.regexp_replace(part(2), "_", ""), F.regexp_replace(part(3), "_", "")
    digits = F.ltrim(F.concat(whole, fraction), F.lit("0"))
    kept = F.substring(digits, 1, 15)
    power = part(4).try_cast("int") + 4 * (F.greatest(F.length(digits) - 15, F.lit(0)) - F.length(fraction))
    number = F.coalesce(F.conv(kept, 16, 10).try_cast("double"), F.lit(0.0))
    value = number * F.pow(F.lit(2.0), power.cast("double")) * F.when(part(1) == "-", -1.0).otherwise(1.0)
    return F.when(text.rlike(HEX) & (F.length(F.concat(whole, fraction)) > 0) & (F.abs(value) != float("inf")), value)


def cast_float(text: Column, strict: bool = False) -> Column:
    """A decimal or hexadecimal float, inf or nan by name; else NULL, or an error if ``strict``. Decimals beyond the range are no floats."""
    low = F.lower(F.trim(text))
    named = F.when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).when(low == "nan", float("nan"))
    decimal = F.when(text.rlike(FLOAT) & (F.length(low) <= 800), low.try_cast("double"))
    found = F.coalesce(named, F.when(F.abs(decimal) != float("inf"), decimal), hex_float(text))
    return _or_error(found, text, strict, "float")


def float_to_int(x: Column) -> Column:
    """A float truncated; NaN and what is out of range become the smallest integer."""
    return F.when(F.isnan(x) | (x >= 2.0**63) | (x < -(2.0**63)), F.lit(OUT_OF_RANGE)).otherwise(x.try_cast("bigint"))


def cast_int(text: Column, strict: bool = False) -> Column:
    """An int's text, else a float's, truncated; else NULL, or an error if ``strict``."""
    found = F.coalesce(F.when(text.rlike(INT), F.trim(text).try_cast("bigint")), float_to_int(cast_float(text)))
    return _or_error(F.when(text.isNotNull(), found), text, strict, "int")


def cast_string(x: Column, kind: str) -> Column:
    """The text of a value of ``kind``: int, float, string, bool or timestamp. NULL is the text ``NULL``."""
    shown = {"float": float_g, "timestamp": format_timestamp}.get(kind, lambda v: v.cast("string"))(x)
    return F.coalesce(shown, F.lit("NULL"))


def cast_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "true", True).when(low == "false", False)


STAMP = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?T(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:\d{2}))?$"


def cast_timestamp(text: Column) -> Column:
    """An instant from one of five layouts: yyyyT, yyyy-MMT, yyyy-MM-ddT, ...Thh:mmZ, ...Thh:mm:ss[.f]Z."""
    part = lambda i: F.regexp_extract(text, STAMP, i)
    number = lambda i, d: F.coalesce(part(i).try_cast("int"), F.lit(d))
    day = F.concat(part(1), F.lit("-"), F.lpad(number(2, 1).cast("string"), 2, "0"), F.lit("-"), F.lpad(number(3, 1).cast("string"), 2, "0"))
    clock = F.concat(F.lpad(number(4, 0).cast("string"), 2, "0"), F.lit(":"), F.lpad(number(5, 0).cast("string"), 2, "0"), F.lit(":"), F.lpad(number(6, 0).cast("string"), 2, "0"))
    whole = F.concat(day, F.lit(" "), clock, F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"), F.when(part(8) == "", "Z").otherwise(part(8)))
    full = (part(3) != "") | (part(4) == "")  # a time needs a whole day
    return F.when(text.rlike(STAMP) & full, whole.try_cast("timestamp"))


def format_timestamp(ts: Column) -> Column:
    """The shortest layout that keeps an instant of UTC."""
    micros = F.date_format(ts, "SSSSSS")
    clock = F.date_format(ts, "HH:mm:ss")
    fraction = F.concat(F.lit("."), F.regexp_replace(micros, "0+$", ""))
    return (
        F.when((F.date_format(ts, "MM-dd") == "01-01") & (clock == "00:00:00") & (micros == "000000"), F.date_format(ts, "yyyy'T'"))
        .when((F.date_format(ts, "dd") == "01") & (clock == "00:00:00") & (micros == "000000"), F.date_format(ts, "yyyy-MM'T'"))
        .when((clock == "00:00:00") & (micros == "000000"), F.date_format(ts, "yyyy-MM-dd'T'"))
        .when((F.date_format(ts, "ss") == "00") & (micros == "000000"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'"))
        .when(micros == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z")))
    )


def to_string(ts: Column, pattern: str) -> Column:
    """An instant of UTC by a pattern of letters; other characters stand for themselves, as does what is between quotes.

    A run of one letter is one part: y year (``yy`` its last two digits), M month (MMM, MMMM its name, MMMMM its first letter), d day,
    h and H hour of 12 and 24, m minute, s second, each with as many digits as letters at least; S that many digits of the
    fraction, n nanoseconds, a AM or PM, X and x the offset (X: Z).
    """
    padded = lambda x, k: F.when(F.length(x.cast("string")) >= k, x.cast("string")).otherwise(F.lpad(x.cast("string"), k, "0"))
    shown = lambda layout: F.date_format(ts, layout)
    nanos = lambda: F.concat(shown("SSSSSS"), F.lit("000"))
    names = {3: lambda: shown("MMM"), 4: lambda: shown("MMMM")}
    parts = {
        "y": lambda k: padded(F.year(ts) % 100, 2) if k == 2 else padded(F.year(ts), k),
        "M": lambda k: padded(F.month(ts), k) if k < 3 else names.get(k, lambda: F.substring(shown("MMMM"), 1, 1))(),
        "d": lambda k: padded(F.dayofmonth(ts), k), "H": lambda k: padded(F.hour(ts), k), "h": lambda k: padded((F.hour(ts) + 11) % 12 + 1, k),
        "m": lambda k: padded(F.minute(ts), k), "s": lambda k: padded(F.second(ts), k), "S": lambda k: F.rpad(F.substring(nanos(), 1, k), k, "0"),
        "n": lambda k: nanos().cast("int").cast("string"), "a": lambda k: F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        "X": lambda k: F.lit("Z"), "x": lambda k: F.lit({1: "+00", 3: "+00:00"}.get(k, "+00:00" if k > 4 else "+0000")),
    }
    out = []
    for m in re.finditer(r"'((?:[^']|'')+)(?:'|$)|(?:'')+|(.)\2*", pattern, re.DOTALL):
        if m[2] in parts and m[2] is not None:
            out.append(parts[m[2]](len(m[0])))
        else:
            out.append(F.lit(m[1].replace("''", "'") if m[1] else m[0].replace("''", "'") if m[0][0] == "'" else m[0]))
    return F.concat(F.lit(""), *out)


def timezone_part(text: Column, part: str) -> Column:
    """EXTRACT of TIMEZONE_HOUR or TIMEZONE_MINUTE: of the offset that a timestamp's text has, both with its sign; 0 for Z or none."""
    offset = F.regexp_extract(text, STAMP, 8)
    digits = F.substring(offset, 2, 2) if part == "TIMEZONE_HOUR" else F.substring(offset, 5, 2)
    number = F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")) * F.when(offset.startswith("-"), -1).otherwise(1)
    return F.when(cast_timestamp(text).isNotNull(), number)


def utcnow() -> Column:
    """The instant of the query, one for all its rows."""
    return F.current_timestamp()


# --- strings -------------------------------------------------------------------------------------------------------


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """From code point ``start`` on; a start under 1 counts as 1 and does not shorten the length."""
    at = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    n = F.char_length(s) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substr(s, at, n)


def trim(s: Column, where: str = "BOTH", chars: str = " ") -> Column:
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[where](s, F.lit(chars))


def upper(s: Column) -> Column:
    """Upper case, but ``ß`` stays."""
    return F.array_join(F.transform(F.split(s, "ß", -1), F.upper), "ß")


# --- dates ---------------------------------------------------------------------------------------------------------

SECONDS = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def date_add(part: str, quantity: int | Column, ts: Column) -> Column:
    """Adding a month to its 31st goes on into the month after where the day does not exist."""
    n = F.lit(quantity) if isinstance(quantity, int) else quantity.cast("int")
    if part in ("YEAR", "MONTH"):
        first = F.date_trunc("month", ts) + (F.make_ym_interval(n, F.lit(0)) if part == "YEAR" else F.make_ym_interval(F.lit(0), n))
        return F.timestamp_add("SECOND", F.unix_seconds(ts) - F.unix_seconds(F.date_trunc("month", ts)), first)
    return F.timestamp_add(part, n, ts)


def date_diff(part: str, a: Column, b: Column) -> Column:
    """YEAR counts anniversaries, MONTH the calendar's months, the others elapsed time, truncated; b before a gives the negative."""
    if part == "MONTH":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    if part == "YEAR":
        key = lambda t: F.date_format(t, "MMddHHmmss.SSSSSS")
        low, high = F.least(a, b), F.greatest(a, b)
        years = F.year(high) - F.year(low) - F.when(key(high) < key(low), 1).otherwise(0)
        return F.when(b >= a, years).otherwise(-years).cast("bigint")
    return F.call_function("div", F.unix_micros(b) - F.unix_micros(a), F.lit(SECONDS[part] * 1_000_000).cast("bigint"))


# --- aggregates ----------------------------------------------------------------------------------------------------


def total(x: Column) -> Column:
    """SUM is a float, and 0 over nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def count_csv(field: Column) -> Column:
    """COUNT of a CSV field: every record has one, be it short or empty."""
    return F.count(F.lit(1))


def count_json(document: Column, path: str) -> Column:
    """COUNT of a value in a VARIANT: a missing one counts, a null doesn't."""
    return F.count_if(~F.coalesce(F.is_variant_null(F.try_variant_get(document, path, "variant")), F.lit(False)))
