"""Windows over the whole order give the same in one task and in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import whole_order as W


@pytest.fixture
def blocks(spark):
    spark.conf.set(W.SINGLE_TASK, "0")
    yield
    spark.conf.unset(W.SINGLE_TASK)


def _frame(spark, n):
    rng = random.Random(3)
    rows = [(rng.choice([None, float("nan"), -0.5, 1.0, 2.5]), i, rng.choice([None, 1, 2, 3])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k double, o long, v long").repartition(5)


def _all(frame):
    order = ["k", "o"]
    frame = W.number(frame, order, "place")
    frame = W.running_sum(frame, order, F.coalesce("v", F.lit(0)), "total")
    frame = W.last_value(frame, order, F.col("v"), "carried")
    frame = W.earlier_max(frame, order, F.col("v"), "top")
    frame = W.neighbours(frame, order, [("is1", "at1", F.col("v"), -1), ("is2", "at2", F.col("o"), 3), ("is3", "at3", F.col("o"), -7)])
    return W.is_last(frame, order, "end")


@pytest.mark.parametrize("n", [0, 1, 6, 1000])
def test_blocks_equal_one_task(spark, n, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 50)
    frame = _frame(spark, n)
    spark.conf.set(W.SINGLE_TASK, str(1 << 62))
    one = _all(frame).select("o", "place", "total", "carried", "top", "is1", "at1", "is2", "at2", "is3", "at3", "end")
    want = sorted(map(tuple, one.collect()))
    spark.conf.set(W.SINGLE_TASK, "0")
    many = _all(frame).select(one.columns)
    got = sorted(map(tuple, many.collect()))
    spark.conf.unset(W.SINGLE_TASK)
    assert got == want and len(got) == n


def test_blocks_follow_the_order_and_are_even(spark, blocks):
    rows = W.with_blocks(_frame(spark, 2000), ["o"]).groupBy("__block").agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count("*").alias("n")).orderBy("__block").collect()
    assert len(rows) > 1 and all(a["high"] < b["low"] for a, b in zip(rows, rows[1:], strict=False))
    assert max(r["n"] for r in rows) < 2000 * 0.7


def test_small_input_is_one_window(spark):
    plan = W.number(spark.range(10).withColumnRenamed("id", "o"), ["o"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
