"""Every program against the same query in SQL, on whole tables."""

import datetime as dt
import math

import duckdb
import pytest

from rowloom import queries
from rowloom.operators import whole_order

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(repr(x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_matches_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


WHOLE = ["by_two_keys", "sum_global", "retain_last", "lag_lead_shift", "auto_n", "stop_step", "end_flag", "merge_ordinal", "set_concat", "row_loop"]


@pytest.mark.parametrize("name", WHOLE)
def test_matches_sql_in_blocks(spark, db, name):
    spark.conf.set(whole_order.SINGLE_TASK, "0")
    try:
        test_matches_sql(spark, db, name)
    finally:
        spark.conf.unset(whole_order.SINGLE_TASK)
