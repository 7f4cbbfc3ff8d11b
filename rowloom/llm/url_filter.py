"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix and holds for the host's subdomains too. Written as the reversed host and the path,
in hexadecimal, a rule is a prefix and so an interval of keys; the intervals nest or are disjoint. A URL has one key
for each suffix of its host (that many labels reversed, then the path), so it meets rules of every depth.

The sweep: each rule opens at its key (and is then on top of the stack) and closes after its last key (its enclosing
rule is on top again). Rule bounds and URL keys are range-partitioned and sorted together; the last bound before a key
tells the top of the stack there. What is open at the start of a range is carried over from the ranges before it
(one row a range). Of the rules met by a URL's keys the longest wins (host and path together; then the longer host;
then the first by host and path). Equal rules with both verdicts: ``block`` wins.

Edge cases: a null URL or one without ``://`` has an empty host and path and meets no rule (such rows take no part in the
join, however many they are); repeated URLs are judged once and each row gets the verdict; no rules or no URLs are
fine; extra columns are kept, those named like a result under that name with ``_given`` after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host: Column, path: Column) -> Column:
    return F.hex(F.encode(F.concat(_reversed(host), path), "UTF-8"))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``rules``: columns ``rule`` (host and path, like ``net/es/``) and ``verdict``. Gives host, path and key as well; one row a rule."""
    one = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/?#]*(.*)$", 1)
    path = F.when(path == "", "/").otherwise(path)
    split = one.withColumn("r_host", host).withColumn("r_path", path).withColumn("key", _key(host, path))
    best = F.max_by(F.struct("rule", "verdict", "r_host", "r_path"), F.struct("verdict", "rule")).alias("b")
    return split.groupBy("key").agg(best).select("key", "b.*")


def _bounds(rules: DataFrame) -> DataFrame:
    """Opening and closing bound of each rule's interval, with the key of the rule on top of the stack from there on."""
    shorter = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring(F.col("key"), 1, i))
    ends = rules.where(F.length("key") > 1).select("key", F.explode(shorter).alias("outer"))
    around = ends.join(rules.select(F.col("key").alias("outer")), "outer").groupBy("key").agg(F.max_by("outer", F.length("outer")).alias("outer"))
    opens = rules.select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("key").alias("top")).alias("stack"))
    # "G" follows every hexadecimal digit, so it closes the interval after all longer keys. Inner intervals that end
    # with the outer one close before it, as their bounds are longer and begin alike.
    closes = rules.join(around, "key", "left").select(F.concat("key", F.lit("G")).alias("at"), F.lit(0), F.struct(F.col("outer").alias("top")))
    return opens.union(closes)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls``: distinct ``host`` and ``path``. Gives host, path, rule and verdict of those that meet a rule."""
    parsed = parse_rules(rules)
    labels = F.split("host", r"\.", -1)
    suffix = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    deep = urls.where("host <> ''").select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), suffix)).alias("s"))
    keys = deep.select(_key(F.col("s"), F.col("path")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<top:string>").alias("stack"), "host", "path")
    events = _bounds(parsed).withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")}).unionByName(keys)
    # Written once: both readers below must see the same ranges.
    dealt = materialise(events.repartitionByRange("at", "kind", "host", "path").withColumn("range", F.spark_partition_id()), "events")
    sweep = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    last = swept.where("kind = 0").groupBy("range").agg(F.max_by("stack", "at").alias("open"))
    ranges = swept.select("range").distinct().join(last, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("range", F.last("open", ignorenulls=True).over(earlier).alias("carried"))
    met = swept.where("kind = 1").join(carried, "range").select("host", "path", F.coalesce("open.top", F.when(F.col("open").isNull(), F.col("carried.top"))).alias("key")).where("key is not null")
    full = met.join(parsed, "key")
    longest = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host", "r_path")
    return full.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), longest).alias("b")).select("host", "path", "b.*")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none holds) and ``verdict`` (``default`` where none holds)."""
    names = set(pages.columns)
    given = {}
    for c in ("host", "path", "rule", "verdict"):
        if c in names:
            given[c] = f"{c}_given"
            while given[c] in names:
                given[c] += "_"
    source = given.get(url, url)
    plain = pages.withColumnsRenamed(given)
    rows = plain.withColumns({"host": host_of(F.col(f"`{source}`")), "path": path_of(F.col(f"`{source}`"))})
    found = match(rows.select("host", "path").distinct(), rules)
    judged = rows.where("host <> ''").join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    columns = [F.col(f"`{c}`") for c in [*plain.columns, "host", "path", "rule", "verdict"]]
    hostless = rows.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return judged.select(*columns).union(hostless.select(*columns))
