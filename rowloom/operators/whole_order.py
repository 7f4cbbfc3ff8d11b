"""Windows over a dataset's whole order: row numbers, running values, neighbouring rows.

A window without PARTITION BY sends every row to one task. That is the shortest plan for a small input, whose size is
checked first; beyond ``rowloom.singleTaskBytes`` (256 MB of sources by default) rows are worked on in blocks:

* a block is a range of the order, told by bounds from a sample of at most ``SAMPLES`` keys a block; it is a function of the
  row's keys alone, so every branch of a plan, and a task that runs again, agrees on it;
* a running value is a window within each block, on top of what the earlier blocks come to: one row a block, so the
  second window and the broadcast are bounded by the number of blocks;
* a neighbour ``n`` rows away is found among rows numbered that way and cut into chunks; rows near a chunk's edge are
  copied to the chunk that looks at them.

Both ways give the same values (sums of doubles up to the order of addition). Empty inputs, null keys (last) and NaN are
ordered as the single window orders them; equal keys are told apart by nothing in either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SINGLE_TASK, DEFAULT_BYTES = "rowloom.singleTaskBytes", 256 << 20
BLOCK_BYTES, MOST_BLOCKS, SAMPLES = 1 << 30, 16_384, 16
CHUNK = 1_000_000


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _sorted(order: list[str]) -> list[Column]:
    return [_named(c).asc_nulls_last() for c in order]


def _key(order: list[str]) -> Column:
    """The order's keys as one comparable value, nulls last."""
    parts = []
    for i, c in enumerate(order):
        parts += [_named(c).isNull().alias(f"n{i}"), _named(c).alias(f"k{i}")]
    return F.struct(*parts)


def source_bytes(frame: DataFrame) -> int:
    """Bytes of what the plan reads, as Spark knows them; an unknown source counts as a very large one."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_one_task(frame: DataFrame) -> bool:
    return source_bytes(frame) <= int(frame.sparkSession.conf.get(SINGLE_TASK, str(DEFAULT_BYTES)))


def with_blocks(frame: DataFrame, order: list[str], name: str = "__block") -> DataFrame:
    """Rows with the number of their range of the order. One job samples the keys."""
    spark = frame.sparkSession
    wanted = min(MOST_BLOCKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(frame) // BLOCK_BYTES)))
    keys = frame.select(_key(order).alias("key"))
    sample = sorted_sample(keys, wanted * SAMPLES)
    cuts = sample[SAMPLES::SAMPLES] if len(sample) >= wanted * SAMPLES else sample[:: max(1, len(sample) // wanted)]
    if not cuts:
        return frame.withColumn(name, F.lit(0))
    # Two levels, so that a row is compared with about twice the root of the number of bounds.
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    kind = T.ArrayType(keys.schema["key"].dataType)
    bounds = spark.createDataFrame([([g[0] for g in groups], [[], *groups])], T.StructType([T.StructField("heads", kind), T.StructField("groups", T.ArrayType(kind))]))
    key = _key(order)
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    # The list binds the group's number, and each bounds column is used once: so the optimizer puts the subqueries' values
    # where they are used and no row carries them.
    frame = frame.withColumn("__heads", bounds.select("heads").scalar()).withColumn("__groups", bounds.select("groups").scalar())
    block = F.transform(F.array(below(F.col("__heads"))), lambda g: g * (width + 1) + below(F.element_at("__groups", g + 1)))
    return frame.withColumn(name, F.element_at(block, 1)).drop("__heads", "__groups")


def sorted_sample(keys: DataFrame, most: int) -> list:
    """At most ``most`` keys, drawn by a random number each, in order."""
    drawn = keys.orderBy(F.rand(7)).limit(most)
    return [r["key"] for r in drawn.orderBy("key").collect()]


def _over_blocks(blocks: DataFrame, before: Column) -> DataFrame:
    """Per block, ``before`` over all earlier ones; there is one row a block."""
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(blocks.select(F.col("__block").alias("__of"), before.over(earlier).alias("__before")))


def _joined(frame: DataFrame, totals: DataFrame) -> DataFrame:
    return frame.join(totals, F.col("__block") == F.col("__of"), "left")


def number(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place in the order, from 1 (long)."""
    if fits_one_task(frame):
        return frame.withColumn(name, F.row_number().over(Window.orderBy(*_sorted(order))).cast("long"))
    blocked = with_blocks(frame, order)
    totals = _over_blocks(blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("__rows")), F.sum("__rows"))
    own = F.row_number().over(Window.partitionBy("__block").orderBy(*_sorted(order)))
    placed = _joined(blocked.withColumn("__own", own), totals)
    return placed.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__block", "__own", "__of", "__before")


def running_sum(frame: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to and including each row."""
    return _running(frame, order, value, name, F.sum, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))


def last_value(frame: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The last ``value`` that isn't null, up to and including each row."""
    last = lambda c: F.last(c, ignorenulls=True)
    at_end = lambda c: F.max_by(c, F.when(c.isNotNull(), _key(order)))
    return _running(frame, order, value, name, last, at_end, F.coalesce, across=last)


def earlier_max(frame: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The greatest ``value`` of the rows before each row; null for the first."""
    return _running(frame, order, value, name, F.max, F.max, F.greatest, upto=-1)


def _running(frame, order, value, name, within, total, combine, across=None, upto=0):
    rows = lambda w: w.orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, upto)
    if fits_one_task(frame):
        return frame.withColumn(name, within(value).over(rows(Window.partitionBy())))
    blocked = with_blocks(frame, order).withColumn("__value", value)
    sums = blocked.groupBy("__block").agg(total(F.col("__value")).alias("__total"))
    placed = _joined(blocked.withColumn("__own", within(F.col("__value")).over(rows(Window.partitionBy("__block")))), _over_blocks(sums, (across or within)(F.col("__total"))))
    return placed.withColumn(name, combine(F.col("__own"), F.col("__before"))).drop("__block", "__value", "__own", "__of", "__before")


def neighbours(frame: DataFrame, order: list[str], wanted: list[tuple[str, str, Column, int]]) -> DataFrame:
    """For each (there, name, value, n): whether there is a row ``n`` rows on (back, if negative), and ``value`` in it."""
    def columns(frame: DataFrame, window) -> DataFrame:
        for there, name, value, n in wanted:
            move = (lambda c, n=n: F.lag(c, -n)) if n < 0 else (lambda c, n=n: F.lead(c, n))
            frame = frame.withColumn(there, move(F.lit(1)).over(window).isNotNull())
            frame = frame.withColumn(name, move(value).over(window))
        return frame

    if not wanted or fits_one_task(frame):
        return columns(frame, Window.orderBy(*_sorted(order)))
    chunk = max(CHUNK, 2 * max(abs(n) for *_, n in wanted))
    placed = number(frame, order, "__place")
    chunk_of = lambda shift: F.floor((F.col("__place") - 1 - shift) / chunk)
    copies = F.array_distinct(F.array(chunk_of(0), *[chunk_of(n) for n in sorted({n for *_, n in wanted})]))
    dealt = placed.withColumn("__chunk", F.explode(copies))
    moved = columns(dealt, Window.partitionBy("__chunk").orderBy("__place"))
    return moved.where(F.col("__chunk") == chunk_of(0)).drop("__chunk", "__place")


def is_last(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """1 on the last row, else 0."""
    if fits_one_task(frame):
        return frame.withColumn(name, F.lead(F.lit(1)).over(Window.orderBy(*_sorted(order))).isNull().cast("int"))
    rows = frame.groupBy().agg(F.count(F.lit(1)).alias("rows")).scalar()
    return number(frame, order, "__place").withColumn(name, (F.col("__place") == rows).cast("int")).drop("__place")
