import hashlib
import math

import duckdb

from rowloom.llm import mixing, queries


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def poisson(u, rate):
    p = c = math.exp(-rate)
    k = 0
    while u >= c and k < mixing.MOST_COPIES:
        k += 1
        p *= rate / k
        c += p
    return k


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = "doc_id, source, copy, rate, shuffle_key"
    want = db.sql(queries.ORACLE_SQL["op8_mix_sources"]).select(columns).fetchall()
    assert sorted(tuple(r) for r in queries.op8_mix_sources(spark, sf).select(*columns.split(", ")).collect()) == sorted(want)


def test_counts_match_brute_force_and_weights(spark):
    docs = spark.createDataFrame([(i, "big" if i < 6000 else "small") for i in range(8000)], "doc_id long, source string")
    targets = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("absent", 5.0)], "source string, weight double")
    rows = mixing.mix(docs, targets, total=10_000, seed=7).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    rate = {"big": 2500 / 6000, "small": 7500 / 2000}
    want = {i: poisson(uniform(7, i), rate["big" if i < 6000 else "small"]) for i in range(8000)}
    assert got == {i: k for i, k in want.items() if k}
    assert abs(sum(r["source"] == "small" for r in rows) - 7500) < 300 and abs(len(rows) - 10_000) < 400


def test_raising_the_rate_keeps_copies(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(500)], "doc_id long, source string")
    keys = lambda total: {(r["doc_id"], r["copy"]) for r in mixing.mix(docs, total=total).collect()}
    assert keys(400) <= keys(900)


def test_edge_cases(spark):
    rows = [(1, None, "t", 9), (None, "a", None, 9), (2, "a", "", 9), (2, "a", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    got = mixing.mix(docs, total=40, keep_copy=False)
    assert got.columns == docs.columns
    counts = {}
    for r in got.collect():
        counts[r["doc_id"], r["source"]] = counts.get((r["doc_id"], r["source"]), 0) + 1
    assert counts == {(d, s): n * poisson(uniform(42, "" if d is None else d), 20 / k) for d, s, k, n in ((1, None, 1, 1), (None, "a", 3, 1), (2, "a", 3, 2))}
    assert mixing.mix(docs.limit(0)).count() == 0
    none = spark.createDataFrame([("a", 0.0)], "source string, weight double")
    assert mixing.mix(docs, none).count() == 0


def many(doc, rate, seed=42):
    k, i = poisson(uniform(seed, doc), min(rate, mixing.DRAW_RATE)), 1
    while i * mixing.DRAW_RATE < rate:
        k += poisson(uniform(seed, doc, "draw", i), min(rate - i * mixing.DRAW_RATE, mixing.DRAW_RATE))
        i += 1
    return k


def test_small_sources_beside_a_hot_one(spark):
    rows = [(i, "hot") for i in range(30_000)] + [(-1, None), (-2, "tiny"), (-3, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = {}
    for r in mixing.mix(docs).where("source is null or source = 'tiny'").collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    wanted = len(rows) / 3  # 10001: beyond one array of copies
    assert {i: sorted(x) for i, x in got.items()} == {i: list(range(1, many(i, wanted / n) + 1)) for i, n in ((-1, 1), (-2, 2), (-3, 2))}
    assert abs(len(got[-1]) - wanted) < 500 and abs(len(got[-2]) + len(got[-3]) - wanted) < 500


def test_high_rates_are_poisson_and_keep_copies(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(600)], "doc_id long, source string")
    before = {}
    for rate in (21, 22, 60, 100):
        got = {r["doc_id"]: r["count"] for r in mixing.mix(docs, total=600 * rate).groupBy("doc_id").count().collect()}
        assert all(got[i] >= k for i, k in before.items())
        mean = sum(got.values()) / 600
        assert abs(mean - rate) < 5 * math.sqrt(rate / 600) and 0.7 < sum((k - mean) ** 2 for k in got.values()) / 600 / rate < 1.3
        before = got


def test_sql_of_the_query_holds_for_high_rates_too(spark, tmp_path):
    rows = [(i, f"text {i}", "en", None if i == 7 else "rare" if i < 3 else "usual", 6) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "source", "copy", "rate", "shuffle_key", "text"]
    want = db.sql(queries.ORACLE_SQL["op8_mix_sources"]).select(", ".join(columns)).fetchall()
    got = queries.op8_mix_sources(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and max(r["rate"] for r in got) > 90
