"""Programs over the driver's tables, each with the same query in SQL.

Every entry runs on whole tables. Where row order matters the tables are sorted by a unique key first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_more
from .queries_more import targets
from .session import Session

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    s = Session(spark)
    for t in tables:
        s.load(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return s


def program(code: str, *tables: str, out: str = "out", sort: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _session(spark, sf_dir, *tables)
        for t, key in (sort or {}).items():
            s.sort(t, key)
        result = s.submit(code)
        if not result:
            raise RuntimeError(result.render())
        return s.frame(out)

    return run


def helper(build: Callable[[Session], object], *tables: str, out: str = "out") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _session(spark, sf_dir, *tables)
        build(s)
        return s.frame(out)

    return run


def sql(text: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _session(spark, sf_dir, *tables).sql(text)


def _twice(x: float) -> float:
    return 2.0 * x


def apply_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "orders")
    r = s.submit("data out; set orders; d = apply('twice', o_totalprice); keep o_orderkey d; run;", functions={"twice": _twice})
    if not r:
        raise RuntimeError(r.render())
    return s.frame("out")


_MERGE = "data out; merge orders(in=a keep=o_orderkey o_custkey o_totalprice rename=(o_custkey=k)) customer(in=b keep=c_custkey c_name rename=(c_custkey=k)); by k; {} keep k o_orderkey o_totalprice c_name; run;"
_JOIN = "SELECT {} AS k, o_orderkey, o_totalprice, c_name FROM orders {} JOIN customer ON o_custkey = c_custkey"

SQL_JOIN = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
SQL_WINDOW = "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1"
SQL_SETS = "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier"
SQL_ANTI = "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"

# name: (query, SQL or None)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "where_assign": (
        program("data out; set lineitem; where l_quantity > 25; disc_price = round(l_extendedprice * (1 - l_discount), 0.01); keep l_orderkey l_linenumber disc_price; run;", "lineitem"),
        "SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice * (1 - l_discount) / 0.01 + 0.5) * 0.01, 2) AS disc_price FROM lineitem WHERE l_quantity > 25",
    ),
    "two_targets_benchmark": (
        targets("data hi lo; set lineitem; where l_quantity > 4.5; a = round(l_extendedprice * l_tax, 0.01); b = round(l_quantity / 3, 0.01); if a > 1000 then output hi; else output lo; keep l_orderkey l_linenumber a b; run;", "hi lo", "lineitem"),
        "SELECT *, CASE WHEN a > 1000 THEN 'hi' ELSE 'lo' END AS target FROM (SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice * l_tax / 0.01 + 0.5) * 0.01, 2) AS a, round(floor(l_quantity / 3 / 0.01 + 0.5) * 0.01, 2) AS b FROM lineitem WHERE l_quantity > 4.5)",
    ),
    "if_else_case": (
        program("data out; set orders; if o_totalprice > 300000 then seg = 'high'; else if o_totalprice > 100000 then seg = 'mid'; else seg = 'low'; keep o_orderkey seg; run;", "orders"),
        "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS seg FROM orders",
    ),
    "multi_output": (
        targets("data ra rn other; set lineitem; if l_returnflag = 'R' then output ra; else if l_returnflag = 'N' then output rn; else output other; keep l_orderkey l_partkey l_returnflag; run;", "ra rn other", "lineitem"),
        "SELECT l_orderkey, l_partkey, l_returnflag, CASE l_returnflag WHEN 'R' THEN 'ra' WHEN 'N' THEN 'rn' ELSE 'other' END AS target FROM lineitem",
    ),
    "subset_delete": (
        program("data out; set orders; if o_orderstatus = 'F'; if o_totalprice < 1000 then delete; keep o_orderkey; run;", "orders"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice < 1000",
    ),
    "set_concat": (
        program("data out; set customer(keep=c_custkey c_acctbal rename=(c_custkey=id c_acctbal=bal) in=c) supplier(keep=s_suppkey s_acctbal rename=(s_suppkey=id s_acctbal=bal)) indsname=d; is_c = c; src = d; run;", "customer", "supplier"),
        "SELECT c_custkey AS id, c_acctbal AS bal, 1::BIGINT AS is_c, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 0, 'supplier' FROM supplier",
    ),
    "set_interleave_flags": (
        program("data out; set orders(where=(o_orderstatus = 'O') keep=o_orderkey o_custkey o_orderstatus) orders(where=(o_orderstatus = 'P') keep=o_orderkey o_custkey o_orderstatus); by o_custkey; f = first.o_custkey; l = last.o_custkey; keep o_orderkey o_custkey f l; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, o_custkey, row_number() OVER w = 1 AS f, lead(1) OVER w IS NULL AS l FROM orders WHERE o_orderstatus IN ('O', 'P') WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)",
    ),
    "by_first_last": (
        program("data out; set orders; by o_custkey; f = first.o_custkey; l = last.o_custkey; keep o_orderkey f l; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, row_number() OVER w = 1 AS f, lead(1) OVER w IS NULL AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "by_two_keys": (
        program("data out; set orders; by o_custkey o_orderstatus; f = first.o_orderstatus; keep o_orderkey f; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, lag(o_orderstatus) OVER (ORDER BY o_custkey, o_orderstatus, o_orderkey) IS DISTINCT FROM o_orderstatus AS f FROM orders",
    ),
    "sum_running": (
        program("data out; set orders; by o_custkey; if first.o_custkey then total = 0; total + round(o_totalprice, 1); keep o_orderkey total; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, sum(floor(o_totalprice + 0.5)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS total FROM orders",
    ),
    "sum_global": (
        program("data out; set orders; n + 1; keep o_orderkey n; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::DOUBLE AS n FROM orders",
    ),
    "by_fold": (
        program("data out; set orders; by o_custkey; if first.o_custkey then n = 0; n + 1; if last.o_custkey; keep o_custkey n; run;", "orders"),
        "SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey",
    ),
    "retain_last": (
        program("data out; set events; if event_type = 'purchase' then last_id = event_id; retain last_id; keep event_id last_id; run;", "events", sort={"events": "event_id"}),
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_id FROM events",
    ),
    "lag_lead_shift": (
        program("data out; set events; a = lag(value); b = lead(user_id, 2, -1); c = shift('user_id', -3); keep event_id a b c; run;", "events", sort={"events": "event_id"}),
        "SELECT event_id, lag(value) OVER w AS a, lead(user_id, 2, -1) OVER w AS b, lag(user_id, 3) OVER w AS c FROM events WINDOW w AS (ORDER BY event_id)",
    ),
    "auto_n": (
        program("data out; set events; where user_id > 10; n = _n_; keep event_id n; run;", "events", sort={"events": "event_id"}),
        "SELECT event_id, n FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id)::DOUBLE AS n FROM events) WHERE user_id > 10",
    ),
    "stop_step": (
        program("data out; set orders; if o_totalprice > 400000 then stop; keep o_orderkey; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey FROM orders WHERE o_orderkey <= coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 400000), 9223372036854775807)",
    ),
    "end_flag": (program("data out; set orders end=e; if e; keep o_orderkey; run;", "orders", sort={"orders": "o_orderkey"}), "SELECT max(o_orderkey) AS o_orderkey FROM orders"),
    "merge_full": (program(_MERGE.format(""), "orders", "customer"), _JOIN.format("coalesce(o_custkey, c_custkey)", "FULL")),
    "merge_inner": (program(_MERGE.format("if a and b;"), "orders", "customer"), _JOIN.format("o_custkey", "INNER")),
    "merge_left": (program(_MERGE.format("if a;"), "orders", "customer"), _JOIN.format("o_custkey", "LEFT")),
    "merge_anti": (program(_MERGE.format("if b and not a;").replace("orders(in=a", "orders(where=(o_totalprice > 300000) in=a"), "orders", "customer"), _JOIN.format("c_custkey", "RIGHT").replace("FROM orders", "FROM (SELECT * FROM orders WHERE o_totalprice > 300000)") + " WHERE o_orderkey IS NULL"),
    "merge_many_many": (
        program("data out; merge customer(keep=c_custkey c_nationkey rename=(c_nationkey=k)) supplier(keep=s_suppkey s_nationkey rename=(s_nationkey=k)); by k; run;", "customer", "supplier", sort={"customer": "c_custkey", "supplier": "s_suppkey"}),
        """WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
        s AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
        g AS (SELECT k, max(n) AS m FROM (SELECT k, n FROM c UNION ALL SELECT k, n FROM s) GROUP BY k),
        slots AS (SELECT k, unnest(range(1, m + 1)) AS i FROM g)
        SELECT slots.k, c_custkey, s_suppkey FROM slots
        LEFT JOIN (SELECT DISTINCT k, n FROM c) cn ON cn.k = slots.k LEFT JOIN (SELECT DISTINCT k, n FROM s) sn ON sn.k = slots.k
        LEFT JOIN c ON c.k = slots.k AND c.r = least(slots.i, cn.n) LEFT JOIN s ON s.k = slots.k AND s.r = least(slots.i, sn.n)""",
    ),
    "merge_ordinal": (
        program("data out; merge region nation; run;", "region", "nation", sort={"region": "r_regionkey", "nation": "n_nationkey"}),
        "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) n FULL JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) r USING (i)",
    ),
    "options_chain": (
        program("data out; set orders(keep=o_orderkey o_totalprice o_orderstatus drop=o_orderstatus rename=(o_totalprice=p) firstobs=11 obs=500); run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, o_totalprice AS p FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 10",
    ),
    "where_option": (
        program("data out; set orders(where=(o_totalprice >= 1000 and not (o_orderstatus = 'F' or o_orderstatus is null)) keep=o_orderkey o_totalprice o_orderstatus); run;", "orders"),
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND NOT (o_orderstatus = 'F' OR o_orderstatus IS NULL)",
    ),
    "target_options": (
        program("data out(keep=o_orderkey p rename=(o_orderkey=k) where=(p > 1000)); set orders; p = o_totalprice; run;", "orders"),
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000",
    ),
    "do_loop_explode": (
        program("data out; set orders; do i = 1 to 3; x = o_custkey * i; output; end; keep o_orderkey i x; run;", "orders"),
        "SELECT o_orderkey, i, (o_custkey * i)::DOUBLE AS x FROM orders CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS i)",
    ),
    "array_ops": (
        program("data out; set part; array v[2] p_size p_retailprice; do i = 1 to 2; v[i] = v[i] * 2; end; n = dim(v); m = vname(v[2]); keep p_partkey p_size p_retailprice n m; run;", "part"),
        "SELECT p_partkey, p_size::DOUBLE * 2 AS p_size, p_retailprice * 2 AS p_retailprice, 2.0::DOUBLE AS n, 'p_retailprice' AS m FROM part",
    ),
    "string_functions": (
        program("data out; set part; a = upcase(p_name); b = substr(p_name, 2, 4); c = scan(p_name, 2); d = lengthn(p_name); e = index(p_type, 'E'); f = tranwrd(p_brand, 'Brand', 'B'); g = reverse(p_brand); h = catx('-', p_brand, p_type); i = countw(p_name); j = compress(p_name, 'ae'); k = repeat(p_brand, 2); keep p_partkey a b c d e f g h i j k; run;", "part"),
        "SELECT p_partkey, upper(p_name) AS a, substr(p_name, 2, 4) AS b, coalesce(list_filter(string_split(p_name, ' '), lambda x: x <> '')[2], '') AS c, length(p_name)::DOUBLE AS d, strpos(p_type, 'E')::DOUBLE AS e, replace(p_brand, 'Brand', 'B') AS f, reverse(p_brand) AS g, p_brand || '-' || p_type AS h, len(list_filter(string_split(p_name, ' '), lambda x: x <> ''))::DOUBLE AS i, translate(p_name, 'ae', '') AS j, repeat(p_brand, 2) AS k FROM part",
    ),
    "numeric_functions": (
        program("data out; set orders; a = int(-o_totalprice); b = floor(o_totalprice); c = ceil(o_totalprice); d = sign(o_totalprice - 100000); e = max(o_custkey, 700); f = min(o_custkey, 700, .); g = sum(o_custkey, ., 1); h = mod(o_orderkey, 7); i = mean(o_custkey, o_orderkey); j = abs(-o_custkey); k = round(sqrt(o_custkey), 0.001); keep o_orderkey a b c d e f g h i j k; run;", "orders"),
        "SELECT o_orderkey, trunc(-o_totalprice) AS a, floor(o_totalprice) AS b, ceil(o_totalprice) AS c, sign(o_totalprice - 100000)::DOUBLE AS d, greatest(o_custkey, 700)::DOUBLE AS e, least(o_custkey, 700)::DOUBLE AS f, (o_custkey + 1)::DOUBLE AS g, (o_orderkey % 7)::DOUBLE AS h, (o_custkey + o_orderkey) / 2.0::DOUBLE AS i, o_custkey::DOUBLE AS j, round(sqrt(o_custkey), 3) AS k FROM orders",
    ),
    "date_functions": (
        program("data out; set orders; y = year(o_orderdate); m = intck('month', mdy(1, 1, 1992), o_orderdate); d = intck('day', mdy(1, 1, 1992), o_orderdate); keep o_orderkey y m d; run;", "orders"),
        "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, datediff('month', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS m, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS d FROM orders",
    ),
    "missing_functions": (
        program("data out; set events; m = missing(value); n = nmiss(value, user_id, .); c = cmiss(event_type, ''); z = value = .; keep event_id m n c z; run;", "events"),
        "SELECT event_id, value IS NULL AS m, (value IS NULL)::INT + (user_id IS NULL)::INT + 1::DOUBLE AS n, (event_type IS NULL OR event_type = '')::INT + 1::DOUBLE AS c, abs(coalesce(value, 0)) < 2.220446049250313e-16 AS z FROM events",
    ),
    "regex_functions": (
        program("data out; set part; a = prxmatch('/e[a-z]/i', p_type); b = prxchange('s/([AEIOU])/<$1>/', -1, p_type); c = prxchange('s/[AEIOU]/_/', 1, p_type); keep p_partkey a b c; run;", "part"),
        "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)e[a-z]') THEN strpos(p_type, regexp_extract(p_type, '(?i)e[a-z]')) ELSE 0 END::DOUBLE AS a, regexp_replace(p_type, '([AEIOU])', '<\\1>', 'g') AS b, regexp_replace(p_type, '[AEIOU]', '_') AS c FROM part",
    ),
    "formats_put": (
        program("data out; set orders; a = put(o_custkey, z8.); c = put(o_orderkey, comma12.); d = put(o_orderdate, yymmdd10.); e = put(o_orderdate, yymmdd8.); f = put(o_custkey, best.); keep o_orderkey a c d e f; run;", "orders"),
        "SELECT o_orderkey, lpad(o_custkey::VARCHAR, 8, '0') AS a, format('{:,}', o_orderkey) AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y%m%d') AS e, o_custkey::VARCHAR AS f FROM orders",
    ),
    "formats_input": (
        program("data out; set orders; a = input(put(o_orderdate, yymmdd8.), yymmdd8.); b = input(put(o_custkey, z9.), best.); keep o_orderkey a b; run;", "orders"),
        "SELECT o_orderkey, o_orderdate::DATE AS a, o_custkey::DOUBLE AS b FROM orders",
    ),
    "multi_block": (
        program("data a; set orders; where o_orderstatus = 'O'; run; data out; set a; if o_totalprice > 50000; keep o_orderkey; run;", "orders"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000",
    ),
    "row_loop": (program("data out; set events(keep=event_id user_id); d = user_id - lag(user_id * 1); keep event_id d; run;", "events", sort={"events": "event_id"}), "SELECT event_id, (user_id - lag(user_id) OVER (ORDER BY event_id))::DOUBLE AS d FROM events"),
    "sort_nodupkey": (helper(lambda s: (s.sort("orders", "o_orderkey"), s.sort("orders", ["o_custkey"], out="out", nodupkey=True), s.keep("out", "o_custkey o_orderkey")), "orders"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey"),
    "transpose_id": (
        helper(lambda s: (s.load("t", s.sql("select c_nationkey, c_mktsegment, count(*) as n from customer group by all")), s.transpose("t", "c_nationkey", "n", id="c_mktsegment", out="out")), "customer"),
        "SELECT c_nationkey, " + ", ".join(f"nullif(count(*) FILTER (WHERE c_mktsegment = '{m}'), 0) AS \"{m}\"" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY c_nationkey",
    ),
    "transpose_rows": (
        helper(lambda s: (s.sort("nation", "n_nationkey"), s.transpose("nation", "n_regionkey", "n_nationkey", out="out"), s.select("out", "n_regionkey _NAME_ COL1 COL2")), "nation"),
        "SELECT n_regionkey, 'n_nationkey' AS _NAME_, max(n_nationkey) FILTER (r = 1) AS COL1, max(n_nationkey) FILTER (r = 2) AS COL2 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY n_regionkey",
    ),
    "cast_types": (helper(lambda s: (s.cast("part", {"p_size": "float64", "p_partkey": "str"}, out="out"), s.keep("out", "p_partkey p_size")), "part"), "SELECT p_partkey::VARCHAR AS p_partkey, p_size::DOUBLE AS p_size FROM part"),
    "assign_case_when": (
        helper(lambda s: (s.assign("part", out="out", band="case when p_size > 30 then 'L' when p_size > 10 then 'M' else 'S' end", up="upcase(p_brand)", two="p_size * 2"), s.keep("out", "p_partkey band up two")), "part"),
        "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'L' WHEN p_size > 10 THEN 'M' ELSE 'S' END AS band, upper(p_brand) AS up, p_size * 2 AS two FROM part",
    ),
    "helper_chain": (helper(lambda s: s["orders"].where("o_totalprice > 100000", out="out").rename({"o_orderkey": "k"}).select("k o_custkey"), "orders"), "SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_totalprice > 100000"),
    "sql_join_group": (sql(SQL_JOIN, "orders", "customer", "nation"), SQL_JOIN),
    "sql_window": (sql(SQL_WINDOW, "orders"), SQL_WINDOW),
    "sql_set_operation": (sql(SQL_SETS, "customer", "supplier"), SQL_SETS),
    "sql_anti_join": (sql(SQL_ANTI, "customer", "orders"), SQL_ANTI.replace("LEFT ANTI", "ANTI")),
    "dictionary_columns": (helper(lambda s: s.sql("create table out as select memname, name, type, varnum from dictionary.columns where memname = 'NATION'"), "nation"), "SELECT * FROM (VALUES ('NATION', 'n_nationkey', 'num', 1::BIGINT), ('NATION', 'n_name', 'char', 2), ('NATION', 'n_regionkey', 'num', 3)) t(memname, name, type, varnum)"),
    "apply_udf": (apply_udf, "SELECT o_orderkey, 2 * o_totalprice AS d FROM orders"),
}

ALL |= queries_more.ALL
QUERIES = {k: q for k, (q, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
