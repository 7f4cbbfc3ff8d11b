import random

import duckdb

from rowloom.llm import queries, url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    best = None
    for rule, verdict in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(rule), len(h), h, p)
            if best is None or key > best[0]:
                best = (key, rule, verdict)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = db.sql(queries.ORACLE_SQL["op2_url_filter"]).select("page_id, host, path, rule, verdict").fetchall()
    got = [tuple(r) for r in queries.op2_url_filter(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_nested_rules_match_brute_force(spark):
    rng = random.Random(6)
    part = lambda: rng.choice("abAÉ")
    host = lambda n: ".".join("".join(part() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "".join(rng.choice(["a", "b/", "/", "é"]) for _ in range(rng.randint(0, n)))
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rules = {lower(host(3)) + path(3): rng.choice(["allow", "block"]) for _ in range(300)}
    urls = [f"http://{host(5)}{path(6)}{rng.choice(['', '?a=/b', '#x'])}" for _ in range(1500)] + ["http://a", "http://a?b/", "//a/b", "x://", None, "", "http://a/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, table).collect()}
    assert got == {i: brute(u, rules.items()) for i, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 300


def test_edge_cases(spark):
    pages = spark.createDataFrame([("http://A.com/x", "old", 1), ("http://A.com/x", "old", 1), (None, None, 2)], "url string, host string, extra int")
    rules = spark.createDataFrame([("com/", "allow"), ("com/", "block"), (None, "block"), ("net/", None)], "rule string, verdict string")
    got = sorted(url_filter.judge(pages, rules).select("host", "rule", "verdict", "extra").collect(), key=str)
    assert [tuple(r) for r in got] == [("", None, "allow", 2), ("a.com", "com/", "block", 1), ("a.com", "com/", "block", 1)]
    assert sorted(r["host_given"] or "" for r in url_filter.judge(pages, rules).collect()) == ["", "old", "old"]
    clash = spark.createDataFrame([("mine", "http://a.com/x", "p", "r")], "path string, host string, path_given string, rule string")
    row = url_filter.judge(clash, rules, url="host").first().asDict()
    assert row == {"path_given_": "mine", "host_given": "http://a.com/x", "path_given": "p", "rule_given": "r", "host": "a.com", "path": "/x", "rule": "com/", "verdict": "block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_plan_is_native(spark, sf_dir):
    plan = queries.op2_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
