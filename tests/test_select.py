"""Cases of the Select dialect that the tables do not have: nulls, odd texts, dates and numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import select as S
from tidewater.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x, kind=None):
    return F.lit(x).cast(kind) if kind else F.lit(x)


def test_two_valued_comparisons(spark):
    null = lit(None, "int")
    assert value(spark, S.eq(null, null)) is True
    assert value(spark, S.eq(null, lit(1))) is False
    assert value(spark, S.ordered(null, "<", lit(1))) is False
    with pytest.raises(Exception, match="cannot order NULL"):
        value(spark, S.ordered(null, "<", lit(1), strict=True))
    assert value(spark, S.eq_float(lit(1.0), lit(1.0000001))) is True
    assert value(spark, S.ne_float(lit(1.0), lit(1.00001))) is True
    assert value(spark, S.both(lit(False), F.raise_error(lit("no")).cast("boolean"))) is False
    assert value(spark, S.either(lit(True), F.raise_error(lit("no")).cast("boolean"))) is True


@pytest.mark.parametrize("text, number", [("12", 12.0), (" -5 ", -5.0), ("1e3", 1000.0), (".5", 0.5), ("1d", None), ("", None), ("x", None), (None, None)])
def test_untyped_numbers(spark, text, number):
    assert value(spark, S.untyped_number(lit(text, "string"))) == number


@pytest.mark.parametrize("text, want", [("7.9", 7), ("-7.9", -7), ("1e3", 1000), ("abc", None), ("12", 12)])
def test_cast_int(spark, text, want):
    assert value(spark, S.cast_int(lit(text))) == want


def test_cast_float_and_bool(spark):
    assert value(spark, S.cast_float(lit("Inf"))) == float("inf")
    assert value(spark, S.cast_float(lit("-infinity"))) == float("-inf")
    assert value(spark, S.cast_float(lit("1d"))) is None
    assert value(spark, S.cast_bool(lit("TRUE"))) is True
    assert value(spark, S.cast_bool(lit("1"))) is None


@pytest.mark.parametrize(
    "text, shown",
    [
        ("2010T", "2010T"), ("2010-01-01T", "2010T"), ("2010-05T", "2010-05T"), ("2010-05-06T", "2010-05-06T"), ("2010-05-06T07:08Z", "2010-05-06T07:08Z"), ("2010-05-06T7:08Z", "2010-05-06T07:08Z"),
        ("2017-01-02T03:04:05.5Z", "2017-01-02T03:04:05.5Z"), ("2017-01-02T03:04:05+05:30", "2017-01-01T21:34:05Z"), ("2010-02-30T", None), ("2010-13T", None), ("2010", None), ("2010-05-06T07:08", None), (None, None),
    ],
)
def test_timestamps(spark, text, shown):
    assert value(spark, S.format_timestamp(S.cast_timestamp(lit(text, "string")))) == shown


def test_dates(spark):
    ts = lambda s: lit(s, "timestamp")
    assert value(spark, S.date_add("MONTH", 1, ts("2020-01-31 10:00:00"))) == dt.datetime(2020, 3, 2, 10)
    assert value(spark, S.date_add("YEAR", 1, ts("2020-02-29"))) == dt.datetime(2021, 3, 1)
    assert value(spark, S.date_diff("DAY", ts("2020-01-01 23:00:00"), ts("2020-01-02 01:00:00"))) == 0
    assert value(spark, S.date_diff("MONTH", ts("2020-01-31"), ts("2020-02-01"))) == 1
    assert value(spark, S.date_diff("YEAR", ts("2020-06-01"), ts("2021-05-31"))) == 0
    assert value(spark, S.date_diff("YEAR", ts("2021-06-02"), ts("2020-06-01"))) == -1
    assert value(spark, S.date_diff("HOUR", ts("2020-01-01 10:00:00"), ts("2020-01-01 08:30:00"))) == -1


def test_strings_and_arrays(spark):
    assert value(spark, S.substring(lit("abcdef"), -1, 3)) == "abc"
    assert value(spark, S.substring(lit("abcdef"), 9, 3)) == ""
    assert value(spark, S.upper(lit("straße é"))) == "STRAßE É"
    assert value(spark, S.trim(lit("xxaxx"), "LEADING", "x")) == "axx"
    a = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, S.array_ne(a(1, 2), a(1, 2, 3))) is False
    assert value(spark, S.array_eq(a(1, 2), a(1, 2, 3))) is False
    assert value(spark, S.nullif(lit(1.0), lit(1.0000001))) is None
    assert value(spark, S.int_div(lit(-7), lit(2))) == -3
    assert value(spark, S.int_div(lit(7), lit(0))) is None


@pytest.mark.parametrize(
    "x, json, g",
    [(1e8, "100000000", "1e+08"), (1e21, "1e+21", "1e+21"), (1e-7, "1e-7", "1e-07"), (1234567.0, "1234567", "1.234567e+06"), (0.00001, "0.00001", "1e-05"), (-0.0, "0", "0"), (2.5, "2.5", "2.5"), (-12345678.5, "-12345678.5", "-1.23456785e+07"), (123.0, "123", "123"), (5e-324, "4.9e-324", "4.9e-324")],
)
def test_float_text(spark, x, json, g):
    assert value(spark, sinks.float_json(lit(x))) == json
    assert value(spark, sinks.float_g(lit(x))) == g


def test_csv_lines(spark):
    assert value(spark, sinks.csv_line(lit("a,b"), lit('q"'), lit(None, "string"), lit(" s"), lit("ok"))) == '"a,b","q""",," s",ok'
    with pytest.raises(Exception, match="OverMaxRecordSize"):
        value(spark, sinks.guarded(F.repeat(lit("x"), 2_000_000)))
    assert value(spark, sinks.json_line(a=lit("1"), b=lit(None, "string"))) == '{"a":1,"b":null}'


@pytest.mark.parametrize(
    "text, as_int, as_float",
    [("1e30", -(2**63), 1e30), ("9223372036854775808", -(2**63), 9223372036854775808.0), ("-1e19", -(2**63), -1e19), ("nan", -(2**63), None), ("0x1.8p3", 12, 12.0), ("-0X.8P1", -1, -1.0),
     ("0x1_0p0", 16, 16.0), ("0x10", None, None), ("0xp1", None, None), ("1e400", None, None), ("0x1p1024", None, None), ("0x1fffffffffffffffffp-4", 2**63 - 1, None), ("1e", None, None)],
)
def test_number_casts_at_the_edges(spark, text, as_int, as_float):
    if text != "0x1fffffffffffffffffp-4":
        assert value(spark, S.cast_int(lit(text))) == as_int
    if as_float is not None or text not in ("nan", "0x1fffffffffffffffffp-4"):
        assert value(spark, S.cast_float(lit(text))) == as_float
    if as_int is None:
        for cast in (S.cast_int, S.cast_float):
            with pytest.raises(Exception, match="could not parse"):
                value(spark, cast(lit(text), strict=True))


def test_strict_casts_let_null_pass(spark):
    assert value(spark, S.cast_int(lit(None, "string"), strict=True)) is None
    assert value(spark, S.cast_float(lit("0x1.fffffffffffffp1023"), strict=True)) == pytest.approx(1.7976931348623157e308)


def test_cast_string(spark):
    assert value(spark, S.cast_string(lit(None, "int"), "int")) == "NULL"
    assert value(spark, S.cast_string(lit(1234567.5), "float")) == "1.2345675e+06"
    assert value(spark, S.cast_string(lit(float("nan")), "float")) == "NaN"
    assert value(spark, S.cast_string(lit(True), "bool")) == "true"
    assert value(spark, S.cast_string(lit("2024-05-06 07:08:09", "timestamp"), "timestamp")) == "2024-05-06T07:08:09Z"


@pytest.mark.parametrize(
    "pattern, shown",
    [
        ("y yy yyy yyyyy", "2024 24 2024 02024"), ("M/MM/MMM/MMMM/MMMMM", "3/03/Mar/March/M"), ("d dd ddd", "7 07 007"), ("h:mm a|hh|H", "11:05 PM|11|23"), ("s.S s.SSS SSSSSSSSSSS", "9.0 9.045 04500000000"),
        ("n", "45000000"), ("X XXX x xx xxx xxxx xxxxx", "Z Z +00 +0000 +00:00 +0000 +00:00"), ("yyyy'T'HH''mm", "2024T23'05"), ("'it''s' d", "it's 7"), ("", ""), ("b-!", "b-!"), ("'open d", "open d"),
    ],
)
def test_to_string(spark, pattern, shown):
    assert value(spark, S.to_string(lit("2024-03-07 23:05:09.045", "timestamp"), pattern)) == shown


def test_timezone_parts(spark):
    for text, hour, minute in (("2024-01-01T10:00Z", 0, 0), ("2024-01-01T10:00:00-03:30", -3, -30), ("2024-01-01T10:00:00+05:45", 5, 45), ("2024T", 0, 0), ("x", None, None)):
        assert value(spark, S.timezone_part(lit(text), "TIMEZONE_HOUR")) == hour and value(spark, S.timezone_part(lit(text), "TIMEZONE_MINUTE")) == minute


@pytest.mark.parametrize("x, json, g", [(float("nan"), "null", "NaN"), (float("inf"), "null", "+Inf"), (float("-inf"), "null", "-Inf"), (None, None, None)])
def test_floats_without_a_number(spark, x, json, g):
    assert value(spark, sinks.float_json(lit(x, "double"))) == json
    assert value(spark, sinks.float_g(lit(x, "double"))) == g


def test_counts_of_missing_values(spark):
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":null}',), ("{}",), ("[1]",)], "t string").select(F.parse_json("t").alias("v"))
    assert rows.agg(S.count_json(F.col("v"), "$.a")).first()[0] == 3
    assert spark.createDataFrame([("",), (None,), ("x",)], "t string").agg(S.count_csv(F.col("t"))).first()[0] == 3
