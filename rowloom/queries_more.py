"""Further programs with their SQL: functions, formats, control flow, the session's methods, and coded errors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diagnostics import StepError
from .session import Session

Query = Callable[[SparkSession, str], DataFrame]


def _load(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Session:
    s = Session(spark, **options)
    for t in tables:
        s.load(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return s


def _done(result) -> None:
    if not result:
        raise RuntimeError(result.render())


def program(code: str, *tables: str, sort: dict[str, str] | None = None, setup: Callable[[Session], object] | None = None, out: str = "out", **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _load(spark, sf_dir, *tables, **options)
        for t, key in (sort or {}).items():
            s.sort(t, key)
        if setup:
            setup(s)
        _done(s.submit(code))
        return s.frame(out)

    return run


def targets(code: str, outs: str, *tables: str, sort: dict[str, str] | None = None) -> Query:
    """All targets of one step, with a column that names them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _load(spark, sf_dir, *tables)
        for t, key in (sort or {}).items():
            s.sort(t, key)
        _done(s.submit(code))
        frames = [s.frame(t).withColumn("target", F.lit(t)) for t in outs.split()]
        union = frames[0]
        for f in frames[1:]:
            union = union.unionByName(f)
        return union

    return run


def session(build: Callable[[Session], object], *tables: str) -> Query:
    """``build`` gives a DataFrame, or publishes ``out``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _load(spark, sf_dir, *tables)
        made = build(s)
        return made if isinstance(made, DataFrame) else s.frame("out")

    return run


def _rounded(x: str, places: int) -> str:
    return f"(sign({x}) * floor(abs({x}) / 1e-{places}::DOUBLE + 0.5) * 1e-{places}::DOUBLE)"


# ---- coded errors: what a program that must not run is refused with

GOOD = [{"k": 1, "x": 1.5, "t": "a"}, {"k": 1, "x": None, "t": "b"}, {"k": 2, "x": 2.0, "t": ""}]
TEXT_KEY = [{"k": "1", "y": 1}]
SAME_COLUMN = [{"k": 1, "x": 9.0}]
FLAGGED = [{"k": 1, "inn": 1}]
NESTED = [{"k": [1], "z": 1}]

REFUSED = {
    "i3 set of different types": ("data o; set a s; run;", "RUNTIME_SET_SCHEMA_INCOMPATIBLE"),
    "i12 rename of nothing": ("data o; set a(rename=(no=n)); run;", "RUNTIME_DATASET_OPTION_INVALID"),
    "i13 firstobs zero": ("data o; set a(firstobs=0); run;", "RUNTIME_DATASET_OPTION_INVALID"),
    "i16 unknown option": ("data o; set a(nodup=1); run;", "PARSE_UNSUPPORTED_STATEMENT"),
    "i16 end in parentheses": ("data o; set a(end=e); run;", "PARSE_SET_OPTION_SCOPE_ERROR"),
    "i18 name collision": ("data o; set f(in=inn); run;", "RUNTIME_INTERNAL_VAR_NAME_COLLISION"),
    "no dataset": ("data o; set nowhere; run;", "RUNTIME_SET_DATASET_NOT_FOUND"),
    "j3 key types differ": ("data o; merge a s; by k; run;", "RUNTIME_BY_PRECONDITION_FAILED"),
    "j4 duplicate column": ("data o; merge a d; by k; run;", "RUNTIME_MERGE_DUPLICATE_COLUMN"),
    "j9 nested key": ("data o; set n; by k; run;", "RUNTIME_BY_PRECONDITION_FAILED"),
    "by key missing": ("data o; set a; by nokey; run;", "RUNTIME_BY_PRECONDITION_FAILED"),
    "c6 do while": ("data o; set a; do while (x > 1); end; run;", "PARSE_UNSUPPORTED_STATEMENT"),
    "o4 unknown target": ("data o; set a; if x > 1 then output p; run;", "REQ_INVALID_OUTPUT_TARGETS"),
    "o6 in on output": ("data o(in=v); set a; run;", "PARSE_UNSUPPORTED_STATEMENT"),
    "o13 duplicate target": ("data o o; set a; run;", "VALIDATE_DUPLICATE_DATA_TARGET"),
    "o14 reserved target": ("data dictionary.x; set a; run;", "VALIDATE_RESERVED_OUTPUT_TARGET"),
    "rename twice": ("data o; set a; rename x=y x=z; run;", "RUNTIME_RENAME_STATEMENT_INVALID"),
    "keep of nothing": ("data o; set a; keep nope; run;", "VALIDATE_COLUMN_NOT_FOUND"),
    "a8 format statement": ("data o; set a; format x 8.2; run;", "RUNTIME_RUST_STATEMENT_UNSUPPORTED"),
    "unknown function": ("data o; set a; z = intnx('day', x, 1); run;", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    "array bounds": ("data o; set a; array v[2] x k; z = v[3]; run;", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    "apply target": ("data o; set a; z = apply('nosuchfunction', x); run;", "RUNTIME_APPLY_TARGET_UNRESOLVED"),
    "apply of a number": ("data o; set a; z = apply(1, x); run;", "RUNTIME_APPLY_TARGET_INVALID"),
    "no source": ("data o; x = 1; run;", "VALIDATE_SOURCE_REQUIRED"),
    "format without dot": ("data o; set a; z = put(x, comma8); run;", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    "c10 fault in a row": ("data o; set a; z = input(t, best.); run;", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    "fine": ("data o; set a; z = x + 1; run;", "OK"),
}


def coded_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each program's code, and whether it left ``o`` behind; faults of rows are found by the check at submit."""
    rows = []
    for case, (code, _) in REFUSED.items():
        s = Session(spark, check_outputs=True)
        s.loads({"a": GOOD, "s": TEXT_KEY, "d": SAME_COLUMN, "f": FLAGGED, "n": NESTED})
        r = s.submit(code)
        rows.append((case, "OK" if r else [e.code for e in r.log if e.level == "error"][-1], "o" in s.datasets))
    return spark.createDataFrame(rows, "program string, code string, published boolean")


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def session_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog and export methods, each with what it gave."""
    s = _load(spark, sf_dir, "region", "nation")
    s.loads({"one": GOOD, "two": TEXT_KEY}, two=GOOD[:1], three=TEXT_KEY)
    out = [("loads", ",".join(sorted(s.datasets))), ("kwargs win", str(len(s.to_pylist("two"))))]
    s.unload("one", "nothing")
    s.delete("three")
    out.append(("unload", ",".join(sorted(s.datasets))))
    try:
        s.unload("nothing", missing_ok=False)
    except KeyError:
        out.append(("unload missing", "KeyError"))
    try:
        s.load("dictionary.tables", GOOD)
    except ValueError:
        out.append(("load reserved", "ValueError"))
    out.append(("to_arrow", str(s.to_arrow("region").num_rows)))
    out.append(("to_pandas", ",".join(s.to_pandas("nation").columns)))
    out.append(("session[name]", ",".join(s["REGION"].columns)))
    out.append(("work", ",".join(sorted(s.work))))
    out.append(("convert", str(s.convert("two", "pylist")[0]["k"])))
    try:
        s.convert("two", "sas7bdat")
    except StepError as e:
        out.append(("convert unsupported", e.entry.code))
    out.append(("formats", f"{s.check_format_support('arrow_table')},{s.check_format_support('csv')},{len(s.list_supported_formats())}"))
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "step.sas"
        path.write_text("data inc; set region; where r_regionkey > 2; run;", encoding="utf-8")
        _done(s.include(str(path)))
    out.append(("include", str(len(s.to_pylist("inc")))))
    r = s.submit("data x; set region; run;", backend="sideways")
    out.append(("backend", r.log[-1].code))
    out.append(("backend rust", str(bool(s.submit("data x; set region; run;", backend="rust")))))
    hooked = Session(spark, macro_hook=lambda code: code.replace("&table", "region"))
    hooked.load("region", s.frame("region"))
    _done(hooked.submit("data x; set &table; run;"))
    out.append(("macro hook", str(len(hooked.to_pylist("x")))))
    r = s.submit("data first; set region; run; data second; set first; nope nope; run;")
    out.append(("a parse error stops all", f"{bool(r)},{'first' in s.datasets}"))
    s.set_option("anything", 5)
    out.append(("options", str(s.get_option("anything"))))
    return spark.createDataFrame(out, "method string, gave string")


_SESSION_ROWS = [
    ("loads", "nation,one,region,three,two"), ("kwargs win", "1"), ("unload", "nation,region,two"), ("unload missing", "KeyError"), ("load reserved", "ValueError"),
    ("to_arrow", "5"), ("to_pandas", "n_nationkey,n_name,n_regionkey"), ("session[name]", "r_regionkey,r_name"), ("work", "nation,region,two"), ("convert", "1"),
    ("convert unsupported", "CONVERT_OUTPUT_FORMAT_UNSUPPORTED"), ("formats", "True,False,3"), ("include", "2"), ("backend", "REQ_INVALID_EXECUTION_MODE"), ("backend rust", "True"),
    ("macro hook", "5"), ("a parse error stops all", "False,False"), ("options", "5"),
]


# ---- functions for apply

def initials(name, n):
    return "-".join(w[:1] for w in name.split()) + str(int(n))


def is_even(x) -> bool:
    return x % 2 == 0


def apply_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _load(spark, sf_dir, "part")
    half = lambda x: x / 2  # noqa: E731, F841 - found in the caller's frame
    code = "data out; set part; a = apply('initials', p_name, p_size); b = apply('is_even', p_size); c = apply('half', p_size); d = apply('len', p_name); e = apply('max', p_size, 10); f = apply('math.floor', p_retailprice); keep p_partkey a b c d e f; run;"
    _done(s.submit(code))
    return s.frame("out")


ALL: dict[str, tuple[Query, str | None]] = {
    "string_functions_2": (
        program("data out; set part; a = trim(cat('  ', p_name, ' ')); b = strip(cat(' ', p_brand)); c = propcase(cat(p_type, ' xY')); d = find(p_type, 'n', 1, 'i'); e = find(p_type, 'O', 4); f = translate(p_brand, 'xy', 'an'); g = cat(p_brand, '-', p_size, ., ''); h = cats(' a ', p_brand, 1.5); i = catt('q  ', p_brand); j = lowcase(p_type); k = length(p_name); l = substr(p_name, -2, 3); m = scan(p_name, 9); n = compress(cat(' ', p_name)); o = countw(p_name, 'a'); p = repeat(p_brand, 0); q = index(p_name, ''); keep p_partkey a b c d e f g h i j k l m n o p q; run;", "part"),
        "SELECT p_partkey, p_name AS a, p_brand AS b, upper(p_type[1]) || lower(p_type[2:]) || ' Xy' AS c, strpos(lower(p_type), 'n')::DOUBLE AS d, CASE WHEN strpos(substr(p_type, 4), 'O') > 0 THEN strpos(substr(p_type, 4), 'O') + 3 ELSE 0 END::DOUBLE AS e, translate(p_brand, 'an', 'xy') AS f, p_brand || '-' || p_size AS g, 'a' || p_brand || '1.5' AS h, 'q' || p_brand AS i, lower(p_type) AS j, length(p_name)::DOUBLE AS k, substr(p_name, 1, 3) AS l, '' AS m, replace(p_name, ' ', '') AS n, len(list_filter(string_split(p_name, 'a'), lambda x: x <> ''))::DOUBLE AS o, '' AS p, 1.0::DOUBLE AS q FROM part",
    ),
    "numeric_functions_2": (
        program("data out; set orders; a = round(exp(o_custkey / 1000), 0.0001); b = round(log(o_orderkey + 1), 0.0001); c = round(log(o_orderkey + 1, 10), 0.0001); d = pow(o_custkey, 2); e = o_custkey ** 2; f = -o_orderkey mod 7; g = 1 / (o_custkey * 0 + 0); h = -5 / 0; i = log(0); j = round(o_totalprice / 3, 0.5); k = max(., o_custkey); l = sum(., .); m = sqrt(o_custkey * o_custkey); n = round(2.5) + round(-2.5) + round(0.49999999999999994); o = o_totalprice * 2 - 1; p = o_custkey + .; q = missing(p); keep o_orderkey a b c d e f g h i j k l m n o q; run;", "orders"),
        f"SELECT o_orderkey, round({_rounded('exp(o_custkey / 1000.0::DOUBLE)', 4)}, 4) AS a, round({_rounded('ln(o_orderkey + 1)', 4)}, 4) AS b, round({_rounded('(ln(o_orderkey + 1) / ln(10))', 4)}, 4) AS c, (o_custkey * o_custkey)::DOUBLE AS d, (o_custkey * o_custkey)::DOUBLE AS e, -(o_orderkey % 7)::DOUBLE + 0.0::DOUBLE AS f, 'inf'::DOUBLE AS g, '-inf'::DOUBLE AS h, '-inf'::DOUBLE AS i, floor(o_totalprice / 3 / 0.5::DOUBLE + 0.5) * 0.5::DOUBLE AS j, o_custkey::DOUBLE AS k, 0.0::DOUBLE AS l, o_custkey::DOUBLE AS m, 0.0::DOUBLE AS n, round(o_totalprice * 2 - 1, 2) AS o, true AS q FROM orders",
    ),
    "operators_text": (
        program("data out; set part; a = p_brand || '/' || p_size || .; b = p_name + p_brand; c = cat(p_size > 10, '|', p_retailprice); d = nosuch; e = missing(d) and not missing(p_name); f = p_name < 'm' or p_size >= 20; g = p_brand ^= 'Brand#2'; h = '5' + 1; keep p_partkey a b c e f g h; run;", "part"),
        "SELECT p_partkey, p_brand || '/' || p_size AS a, p_name || p_brand AS b, (p_size > 10)::VARCHAR || '|' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS c, true AS e, p_name < 'm' OR p_size >= 20 AS f, p_brand <> 'Brand#2' AS g, 6.0::DOUBLE AS h FROM part",
    ),
    "if_do_blocks": (
        targets("data hi lo; set orders; if o_totalprice > 250000 then do; k = 'big'; if o_orderstatus = 'F' then do; k = 'done'; n = 1; end; else do; n = 2; end; output hi; end; else do; k = 'small'; n = 3; output lo; end; keep o_orderkey k n; run;", "hi lo", "orders"),
        "SELECT o_orderkey, CASE WHEN o_totalprice <= 250000 THEN 'small' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'big' END AS k, CASE WHEN o_totalprice <= 250000 THEN 3 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN o_totalprice > 250000 THEN 'hi' ELSE 'lo' END AS target FROM orders",
    ),
    "do_loop_computed": (
        program("data out; set part; n = mod(p_size, 4); do i = 1 to n; x = p_size * i; output; end; do j = 3 to 1; x = 0; output; end; keep p_partkey i x; run;", "part"),
        "SELECT p_partkey, i, (p_size * i)::DOUBLE AS x FROM (SELECT p_partkey, p_size, unnest(range(1, p_size % 4 + 1)) AS i FROM part)",
    ),
    "merge_end": (
        program("data out; merge customer(keep=c_custkey c_name rename=(c_custkey=k)) orders(keep=o_custkey o_orderkey rename=(o_custkey=k)) end=e; by k; if e; keep k c_name o_orderkey; run;", "customer", "orders", sort={"orders": "o_orderkey"}),
        "SELECT k, c_name, o_orderkey FROM (SELECT coalesce(c_custkey, o_custkey) AS k, c_name, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey) ORDER BY k DESC, o_orderkey DESC LIMIT 1",
    ),
    "merge_options_per_source": (
        program("data out; merge orders(where=(o_orderstatus = 'F') keep=o_orderkey o_orderstatus in=a) orders(where=(o_totalprice > 200000) keep=o_orderkey o_totalprice in=b); by o_orderkey; x = a; y = b; keep o_orderkey x y o_totalprice; run;", "orders"),
        "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS x, (o_totalprice > 200000)::BIGINT AS y, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000",
    ),
    "merge_three_sources": (
        program("data out; merge nation(keep=n_regionkey n_nationkey rename=(n_regionkey=k)) region(rename=(r_regionkey=k)) nation(keep=n_regionkey n_name rename=(n_regionkey=k)); by k; keep k n_nationkey r_name n_name; run;", "nation", "region", sort={"nation": "n_nationkey"}),
        "SELECT n_regionkey AS k, n_nationkey, r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "label_statement": (
        session(lambda s: (_done(s.submit("data lab(label='Nations of the world'); set nation; label n_name='Name of the nation' n_regionkey=\"Region\"; run;")), s.sql("create table out as select name, label from dictionary.columns where memname = 'LAB'")), "nation"),
        _values([("n_nationkey", ""), ("n_name", "Name of the nation"), ("n_regionkey", "Region")], "name, label"),
    ),
    "label_lineage": (
        session(lambda s: (_done(s.submit("data lab; set nation; label n_name='Name'; run; data two; set lab(rename=(n_name=nm)); x = n_nationkey; run;")), s.select("two", "nm x", out="three"), s.sort("three", "x", out="four"), s.sql("create table out as select memname, name, label from dictionary.columns where label <> ''")), "nation"),
        _values([("LAB", "n_name", "Name"), ("TWO", "nm", "Name"), ("THREE", "nm", "Name"), ("FOUR", "nm", "Name")], "memname, name, label"),
    ),
    "dictionary_tables": (
        session(lambda s: (_done(s.submit("data lab(label='All of them'); set nation; run;")), s.sql("create table out as select memname, memlabel, nobs, nvar from dictionary.tables")), "nation", "region", "orders"),
        "SELECT 'NATION' AS memname, '' AS memlabel, count(*) AS nobs, 3::BIGINT AS nvar FROM nation UNION ALL SELECT 'REGION', '', count(*), 2 FROM region UNION ALL SELECT 'ORDERS', '', count(*), 6 FROM orders UNION ALL SELECT 'LAB', 'All of them', count(*), 3 FROM nation",
    ),
    "dictionary_in_step": (
        session(lambda s: _done(s.submit("data out; set dictionary.columns; where type = 'char'; keep memname name varnum; run;")), "nation", "region"),
        _values([("NATION", "n_name", 2), ("REGION", "r_name", 2)], "a, b, c").replace("SELECT *", 'SELECT a AS "MEMNAME", b AS "NAME", c::BIGINT AS "VARNUM"'),
    ),
    "drop_table": (
        session(lambda s: (s.sql("drop table nation"), s.sql("drop table if exists nothing"), s.sql("create table out as select memname from dictionary.columns where varnum = 1")), "nation", "region", "supplier"),
        "SELECT * FROM (VALUES ('REGION'), ('SUPPLIER')) t(memname)",
    ),
    "session_methods": (session_methods, _values(_SESSION_ROWS, "method, gave")),
    "coded_errors": (coded_errors, _values([(k, c, c == "OK") for k, (_, c) in REFUSED.items()], "program, code, published")),
    "formats_more": (
        program("data out; set events; a = put(value, 10.1); b = put(ts, e8601da.); c = put(ts, e8601dt.); d = put(ts, time.); e = put(event_type, $kind.); f = put(user_id, band.); g = put(value, best.); h = put(-event_id, z9.2); i = put(event_id * 1.5, comma12.2); j = put(ts, yymmdd6.); keep event_id a b c d e f g h i j; run;", "events", setup=lambda s: (s.register_format("$kind.", {"click": "C", "error": "E"}), s.register_format("band.", {1: "one", 2: "two"}))),
        "SELECT event_id, format('{:.1f}', value) AS a, strftime(ts, '%Y-%m-%d') AS b, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS c, strftime(ts, '%H:%M:%S') AS d, CASE event_type WHEN 'click' THEN 'C' WHEN 'error' THEN 'E' ELSE event_type END AS e, CASE user_id WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE user_id::VARCHAR END AS f, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS g, CASE WHEN event_id = 0 THEN '000000.00' ELSE '-' || lpad(format('{:.2f}', event_id::DOUBLE), 8, '0') END AS h, format('{:,.2f}', event_id * 1.5::DOUBLE) AS i, strftime(ts, '%y%m%d') AS j FROM events",
    ),
    "informats_more": (
        program("data out; set events; a = put(input(put(ts, e8601dt.), e8601dt.), e8601dt.); b = input(put(ts, e8601da.), e8601da.); c = input(put(ts, yymmdd6.), yymmdd6.); d = input('  ', best.); e = missing(d); f = input(event_type, code.); g = round(hour('10:30') + hour(input('01:15:36', time.)), 0.01); h = input(cat(' ', event_id), 8.); keep event_id a b c e f g h; run;", "events", setup=lambda s: s.register_informat("code.", {"click": 7, "view": 8})),
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS a, ts::DATE AS b, ts::DATE AS c, true AS e, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 8 END::DOUBLE AS f, 11.76::DOUBLE AS g, event_id::DOUBLE AS h FROM events",
    ),
    "hour_function": (program("data out; set events; h = round(hour(ts), 0.001); keep event_id h; run;", "events"), "SELECT event_id, round(floor((hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE) / 0.001::DOUBLE + 0.5) * 0.001::DOUBLE, 3) AS h FROM events"),
    "lag_of_step_variable": (program("data out; set events; y = value * 2; m = missing(lag(y)); z = lag(y, 1, 5); keep event_id m z; run;", "events", sort={"events": "event_id"}), "SELECT event_id, true AS m, 5::BIGINT AS z FROM events"),
    "lag_in_order_before_where": (program("data out; set events; where user_id > 20; a = lag(user_id); keep event_id a; run;", "events", sort={"events": "event_id"}), "SELECT event_id, a FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS a FROM events) WHERE user_id > 20"),
    "sum_into_source_column": (program("data out; set orders; o_custkey + 1; if o_orderstatus = 'F' then o_totalprice + 10; keep o_orderkey o_custkey; run;", "orders"), "SELECT o_orderkey, (o_custkey + 1)::DOUBLE AS o_custkey FROM orders"),
    "retain_initial_value": (program("data out; set nation; retain c 5; c = c + n_nationkey; keep n_nationkey c; run;", "nation", sort={"nation": "n_nationkey"}, retain_initial=True), "SELECT n_nationkey, 5.0::DOUBLE + sum(n_nationkey) OVER (ORDER BY n_nationkey)::DOUBLE AS c FROM nation"),
    "row_loop_by_group": (
        program("data out; set orders; by o_custkey; if first.o_custkey then do; b = 0; n = 0; end; b + round(o_totalprice); n + (b > 500000); if b > 500000 then b = 0; keep o_orderkey b n; run;", "orders", sort={"orders": "o_orderkey"}),
        """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice + 0.5) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
        w AS (SELECT o_custkey, o_orderkey, r, CASE WHEN x > 500000 THEN 0 ELSE x END::DOUBLE AS b, CASE WHEN x > 500000 THEN 1 ELSE 0 END::DOUBLE AS n FROM o WHERE r = 1
              UNION ALL SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN b + x > 500000 THEN 0 ELSE b + x END::DOUBLE, n + CASE WHEN b + x > 500000 THEN 1 ELSE 0 END::DOUBLE FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.r = w.r + 1)
        SELECT o_orderkey, b, n FROM w""",
    ),
    "row_loop_state": (
        program("data out; set nation; b + n_nationkey; if b > 20 then b = 0; keep n_nationkey b; run;", "nation", sort={"nation": "n_nationkey"}),
        "WITH RECURSIVE w AS (SELECT 0 AS k, 0.0::DOUBLE AS b UNION ALL SELECT k + 1, CASE WHEN b + k + 1 > 20 THEN 0 ELSE b + k + 1 END::DOUBLE FROM w WHERE k < (SELECT max(n_nationkey) FROM nation)) SELECT k::INTEGER AS n_nationkey, b FROM w",
    ),
    "missing_comparisons": (
        program("data out; set events; a = value > 50; b = value <= 0; c = . = 0; d = . < 1; e = value = .; f = '' = event_type; g = not value; h = value ^= 6.55; i = 3 < user_id; j = user_id = 8; keep event_id a b c d e f g h i j; run;", "events"),
        "SELECT event_id, coalesce(value, 0) > 50 AS a, coalesce(value, 0) <= 0 AS b, true AS c, true AS d, abs(coalesce(value, 0)) < 2.220446049250313e-16 AS e, coalesce(event_type, 'x') = '' AS f, abs(coalesce(value, 0)) < 2.220446049250313e-16 AS g, coalesce(value, 0) <> 6.55 AS h, 3 < coalesce(user_id, 0) AS i, coalesce(user_id, 0) = 8 AS j FROM events",
    ),
    "where_last_wins": (program("data out; set orders; where o_orderstatus = 'F'; where o_totalprice > 100000 and o_orderstatus = 'O'; keep o_orderkey; run;", "orders"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'"),
    "comments_macros_procs": (
        program("/* a comment; */ %let x = 5; proc print data=orders; var x; run; * another; data out; /* set nothing; */ set orders; * where o_custkey > 3; e = _error_; if o_orderstatus = 'P'; keep o_orderkey e; run; %put done;", "orders"),
        "SELECT o_orderkey, 0.0::DOUBLE AS e FROM orders WHERE o_orderstatus = 'P'",
    ),
    "first_last_cases": (
        program("data out; set orders; by o_custkey; where o_orderstatus = 'F'; if FIRST.O_CustKey or Last.o_custkey; f = first.O_CUSTKEY; keep o_orderkey f; run;", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey, f FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER w = 1 AS f, lead(1) OVER w IS NULL AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE o_orderstatus = 'F' AND (f OR l)",
    ),
    "default_target": (
        targets("data a b; set orders; if o_totalprice > 300000 then output b; output c; keep o_orderkey; run;", "b c", "orders"),
        "SELECT o_orderkey, 'b' AS target FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'c' FROM orders",
    ),
    "implicit_default_target": (targets("data a b; set orders; x = 1; keep o_orderkey x; run;", "a b", "orders"), "SELECT o_orderkey, 1::BIGINT AS x, 'a' AS target FROM orders"),
    "targets_with_options": (
        targets("data big(where=(p > 300000) rename=(o_orderkey=k) keep=o_orderkey p) few(keep=o_orderkey p firstobs=3 obs=4 rename=(o_orderkey=k)); set orders; p = o_totalprice; output; run;", "big few", "orders", sort={"orders": "o_orderkey"}),
        "SELECT o_orderkey AS k, o_totalprice AS p, 'big' AS target FROM orders WHERE o_totalprice > 300000 UNION ALL (SELECT o_orderkey, o_totalprice, 'few' FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 2)",
    ),
    "keep_rename_statements": (
        program("data out; set customer; bal2 = c_acctbal * 2; rename c_custkey=id bal2=b; drop c_mktsegment; keep c_custkey c_mktsegment bal2 c_name; run;", "customer"),
        "SELECT c_custkey AS id, c_name, round(c_acctbal * 2, 2) AS b FROM customer",
    ),
    "all_null_column": (program("data out; set nation; x = .; if n_nationkey < 0 then y = 'text'; z = missing(x) and missing(y); keep n_nationkey y z; run;", "nation"), "SELECT n_nationkey, NULL::VARCHAR AS y, true AS z FROM nation"),
    "array_dynamic": (
        program("data out; set lineitem; array v(*) l_quantity l_extendedprice l_tax; i = mod(l_linenumber, 3) + 1; x = v{i}; v(i) = 0; n = vname(v[2]); keep l_orderkey l_linenumber l_quantity l_extendedprice l_tax x n; run;", "lineitem"),
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END AS l_quantity, CASE WHEN l_linenumber % 3 = 1 THEN 0 ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_linenumber % 3 = 2 THEN 0 ELSE l_tax END AS l_tax, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_tax END AS x, 'l_extendedprice' AS n FROM lineitem",
    ),
    "helper_drop_options": (
        session(lambda s: (s.drop("orders", "o_orderpriority o_orderdate", out="t"), s.apply_options("t", out="u", where="o_totalprice > 100000", rename={"o_custkey": "k"}), s.filter("u", "k >= 100", out="out"), s.keep("out", ["o_orderkey", "k", "o_totalprice"])), "orders"),
        "SELECT o_orderkey, o_custkey AS k, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_custkey >= 100",
    ),
    "assign_functions": (
        session(lambda s: (s.assign("part", out="out", a="propcase(p_type)", b="cats(' x ', p_brand)", c="catx('-', p_brand, p_type)", d="substr(p_name, 2, 3)", e="tranwrd(p_brand, 'Brand', 'B')", f="reverse(p_brand)", g="countw(p_name)", h="scan(p_name, 1)", i="round(p_retailprice / 3, 0.01)", j="put(p_size, z5.)", k="length(p_name)", l="trim(cat('  ', p_brand, '  '))", m="strip(cat('  ', p_brand))", n="repeat(p_brand, 2)", o="compress(p_name, 'ae')", p="lowcase(p_type)", q="translate(p_brand, 'xy', 'an')", r="input(put(p_size, z5.), best.)", t=5), s.keep("out", "p_partkey a b c d e f g h i j k l m n o p q r t")), "part"),
        f"SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) AS a, 'x' || p_brand AS b, p_brand || '-' || p_type AS c, substr(p_name, 2, 3) AS d, replace(p_brand, 'Brand', 'B') AS e, reverse(p_brand) AS f, len(string_split(p_name, ' '))::DOUBLE AS g, string_split(p_name, ' ')[1] AS h, round({_rounded('(p_retailprice / 3)', 2)}, 2) AS i, lpad(p_size::VARCHAR, 5, '0') AS j, length(p_name)::BIGINT AS k, '  ' || p_brand AS l, p_brand AS m, repeat(p_brand, 2) AS n, translate(p_name, 'ae', '') AS o, lower(p_type) AS p, translate(p_brand, 'an', 'xy') AS q, p_size::DOUBLE AS r, 5::BIGINT AS t FROM part",
    ),
    "sort_directions": (
        session(lambda s: (s.sort("customer", [("c_nationkey", "descending"), ("c_acctbal", "ascending")], out="t"), _done(s.submit("data out; set t; n = _n_; keep c_custkey n; run;"))), "customer"),
        "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal, c_custkey)::DOUBLE AS n FROM customer",
    ),
    "sql_out_and_order": (
        session(lambda s: (s.sql("select o_custkey, sum(o_totalprice) as total, count(distinct o_orderstatus) as kinds from orders group by o_custkey having count(*) > 5 order by o_custkey limit 100", out="t"), _done(s.submit("data out; set t; n = _n_; total = round(total); keep o_custkey n kinds; run;"))), "orders"),
        "SELECT o_custkey, row_number() OVER (ORDER BY o_custkey)::DOUBLE AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 5 ORDER BY o_custkey LIMIT 100",
    ),
    "set_same_dataset_twice": (
        program("data out; set region(in=a) region(where=(r_regionkey > 2)); x = a; keep r_regionkey x; run;", "region"),
        "SELECT r_regionkey, 1::BIGINT AS x FROM region UNION ALL SELECT r_regionkey, 0 FROM region WHERE r_regionkey > 2",
    ),
    "interleave_options_twice": (
        program("data out; set customer(keep=c_nationkey c_custkey rename=(c_nationkey=k c_custkey=id) obs=50) supplier(keep=s_nationkey s_suppkey rename=(s_nationkey=k s_suppkey=id) firstobs=3 obs=20) indsname=d; by k; src = d; f = first.k; keep k id src f; run;", "customer", "supplier", sort={"customer": "c_custkey", "supplier": "s_suppkey"}),
        "WITH u AS ((SELECT c_nationkey AS k, c_custkey AS id, 'customer' AS src, 0 AS o FROM customer ORDER BY c_custkey LIMIT 50) UNION ALL (SELECT s_nationkey, s_suppkey, 'supplier', 1 FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 2)) SELECT k, id, src, row_number() OVER (PARTITION BY k ORDER BY o, id) = 1 AS f FROM u",
    ),
    "apply_functions": (
        apply_functions,
        "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '-') || p_size AS a, p_size % 2 = 0 AS b, p_size / 2.0::DOUBLE AS c, length(p_name)::DOUBLE AS d, greatest(p_size, 10)::DOUBLE AS e, floor(p_retailprice)::DOUBLE AS f FROM part",
    ),
    "delete_in_block": (
        program("data out; set orders; if o_orderstatus = 'F' then do; if o_totalprice > 200000 then delete; k = 1; end; else k = 2; keep o_orderkey k; run;", "orders"),
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END::BIGINT AS k FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)",
    ),
    "float_snap": (program("data out; set nation; x = 0.1 + 0.2; y = n_nationkey * 0.1 * 3; z = 1 / 3; keep n_nationkey x y; run;", "nation"), "SELECT n_nationkey, 0.3::DOUBLE AS x, round(n_nationkey * 0.3, 1)::DOUBLE AS y FROM nation"),
}

QUERIES = {k: q for k, (q, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
