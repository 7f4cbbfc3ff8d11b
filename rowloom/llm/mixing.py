"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the wanted total over its size. A document's uniform number comes from a hash of
the seed and its id; its count of copies is the inverse of the Poisson distribution with that rate, at that number.
A rate above ``DRAW_RATE`` is a sum of draws: as many of ``DRAW_RATE`` as fit and one of the rest, each at a number of
its own, which is Poisson with the whole rate again. So any rate is possible, counts do not depend on partitions or
retries, and raising a rate never removes a copy. Copies are then shuffled
globally by a hash of seed, id and copy number: the hash deals them to partitions and orders them there.

Edge cases: a null source is a source of its own; a source without a target has weight zero and goes; a null id hashes
as the empty string; rows with equal ids get equal counts; zero total weight or an empty table gives no rows; extra columns
are kept, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_COPIES = 64  # about the terms of the inverse at the highest rate of one draw
DRAW_RATE = MOST_COPIES / 3  # highest rate of one draw
COPIES_AT_ONCE = 4096  # copies of a document numbered in one array
BROADCAST_SOURCES = 100_000
_UNIT = float(16**13)


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of the parts, colon-separated."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability exceeds ``u``."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = u >= acc["c"]
        return F.struct(p.alias("p"), F.when(more, acc["c"] + p).otherwise(acc["c"]).alias("c"), F.when(more, i).otherwise(acc["k"]).alias("k"))

    # Beyond these terms less than the last bit of ``u`` is left, for rates up to DRAW_RATE.
    terms = F.ceil(rate + 9 * F.sqrt(rate) + 12).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["k"])


def copies_count(seed: int, at: Column, rate: Column) -> Column:
    """Copies of the document with id ``at``: one draw, and further ones of ``DRAW_RATE`` at most while the rate is not used up."""
    first = poisson_count(uniform(F.lit(seed), at), F.least(rate, F.lit(DRAW_RATE)))

    def draw(acc: Column, i: Column) -> Column:
        return acc + poisson_count(uniform(F.lit(seed), at, F.lit("draw"), i), F.least(F.greatest(rate - i * F.lit(DRAW_RATE), F.lit(0.0)), F.lit(DRAW_RATE)))

    more = (F.ceil(rate / F.lit(DRAW_RATE)) - 1).cast("int")
    return F.when(rate <= DRAW_RATE, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), first, draw))


def rates(docs: DataFrame, targets: DataFrame | None, source: str, total: float | None = None) -> DataFrame:
    """``s`` and ``rate`` of each source. ``targets``: columns source, weight; None: equal weights. ``total``: wanted copies; None: as many as documents."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("s")).agg(F.count("*").alias("n"))
    if targets is None:
        weighted = sizes.withColumn("w", F.lit(1.0))
    else:
        t = targets.select(F.col("source").alias("t"), F.col("weight").cast("double").alias("w"))
        weighted = sizes.join(t, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    all_w, all_n = weighted.agg(F.sum("w"), F.sum("n")).first() if total is None else (weighted.agg(F.sum("w")).first()[0], total)
    if not all_w:
        return weighted.select("s", F.lit(0.0).alias("rate"))
    rate = F.lit(float(all_n)) * F.col("w") / F.lit(float(all_w)) / F.col("n")
    return weighted.select("s", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, total: float | None = None, seed: int = 42, doc_id: str = "doc_id", source: str = "source", keep_copy: bool = True) -> DataFrame:
    """The copies, dealt and ordered by ``shuffle_key``, with ``copy`` from 1 on; ``keep_copy=False`` gives the columns of ``docs`` only."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at, of = F.col(f"c{columns.index(doc_id)}"), F.col(f"c{columns.index(source)}")
    table = materialise(rates(docs, targets, source, total), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)  # checked: so few rows; beyond that the join shuffles and splits skewed sources
    rated = plain.join(table, of.eqNullSafe(F.col("s"))).drop("s")
    counted = rated.withColumn("k", copies_count(seed, at, F.col("rate"))).where("k > 0")
    some = counted.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k"), F.lit(COPIES_AT_ONCE))))
    copies = some.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least("k", F.col("from") + F.lit(COPIES_AT_ONCE - 1)))))
    keyed = copies.withColumn("shuffle_key", uniform(F.lit(seed), at, F.col("copy")))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", at)
    out = dealt.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *([F.col("copy"), F.col("rate"), F.col("shuffle_key")] if keep_copy else []))
    return out
