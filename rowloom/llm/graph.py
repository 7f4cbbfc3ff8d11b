"""Connected components by alternating large-star and small-star steps.

Every round is joins and minimum aggregates; neighbour lists are never built. The minima are written before they are
joined, so that the join deals both of its sides itself and can split the links of a hub of any degree like any
other skewed key. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs ``a`` and ``b``; returns each linked node once with the smallest node it reaches: ``node``, ``root``.

    Self links, repeated links and either direction are fine; null ends are left out; no edges give no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, mark = _settle(links, 0)
    rounds = 0
    while mark[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"large{rounds}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, f"star{rounds}")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"small{rounds}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds += 1
        links, now = _settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), rounds)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settle(links: DataFrame, number: int) -> tuple[DataFrame, tuple]:
    links = materialise(links, f"links{number}")
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return links, tuple(row)
