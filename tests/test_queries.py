"""Every query against its SQL in DuckDB, over the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_as_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    cursor = duck.execute(all_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_alert_rates_equal_the_sql_to_the_last_place(spark, tmp_path):
    events = f"""SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 7000013) AS ts, (i * 7919) % 1500 + (i % 60) * {{shift}} AS user_id, concat('t', i % 3) AS event_type FROM range(3000) r(i)"""
    for shift in (0, 100_000_000, 1_000_000_000_000):
        folder = tmp_path / str(shift)
        folder.mkdir()
        con = duckdb.connect()
        con.execute(f"COPY ({events.format(shift=shift)}) TO '{folder}/events.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = sorted(con.execute(f"SELECT event_id, increase, rate, delta, most FROM ({all_sql()['win_promql']})").fetchall())
        assert sorted(map(tuple, all_queries()["win_promql"](spark, str(folder)).collect())) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = all_queries()["where"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity,40.0" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    listed = all_queries()["list_v2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,https://)" in listed and "TakeOrderedAndProject" in listed
