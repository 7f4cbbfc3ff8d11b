import datetime as dt
import math
import random

import pyarrow as pa
import pytest

from rowloom.session import Session


@pytest.fixture
def s(spark):
    return Session(spark)


def rows(s, name="out"):
    return [tuple(r.values()) for r in s.to_pylist(name)]


def ok(s, code, **tables):
    r = s.submit(code, **tables)
    assert r, r.render()
    return rows(s)


def table(columns, *values):
    return [dict(zip(columns.split(), v, strict=True)) for v in values]


IN = table("id amount", (1, 10), (2, 20), (3, None))


def test_projection_filter_and_missing_rules(s):
    assert ok(s, "data out; set a; where amount >= 0; x = amount + 1; y = amount = 0; keep id x y; run;", a=IN) == [(1, 11.0, False), (2, 21.0, False), (3, None, True)]
    assert ok(s, "data out; set a; if id = 1; a1 = . = .; a2 = 1 > .; a3 = . >= .; a4 = . > 1; a5 = ''; a6 = missing(a5); drop id amount; run;", a=IN) == [(True, True, True, False, "", True)]


def test_division_and_logs(s):
    got = ok(s, "data out; set a; if id = 1; a1 = 1/0; a2 = -1/0; a3 = 0/0; a4 = log(0); a5 = 7 mod 0; a6 = -7 mod 3; a7 = 0.1 + 0.2; a8 = mean(.); a9 = sum(.,.); keep a1-a9x; run;".replace("keep a1-a9x;", "drop id amount;"), a=IN)[0]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and math.isnan(got[4])
    assert got[5:7] == (-1.0, 0.3) and math.isnan(got[7]) and got[8] == 0.0


def test_if_else_outputs_and_loops(s):
    code = "data hi lo; set a; if amount > 15 then do; k = 'hi'; output hi; end; else do; k = 'lo'; output lo; end; run;"
    assert s.submit(code, a=IN)
    assert rows(s, "hi") == [(2, 20, "hi")] and rows(s, "lo") == [(1, 10, "lo"), (3, None, "lo")]
    assert ok(s, "data out; set a(obs=1); do i = 1 to 3; t = i * 10; output; end; run;", a=IN) == [(1, 10, 1, 10.0), (1, 10, 2, 20.0), (1, 10, 3, 30.0)]


def test_sum_retain_and_flags(s):
    assert ok(s, "data out; set a; n + 1; run;", a=table("id", (10,), (20,), (30,))) == [(10, 1.0), (20, 2.0), (30, 3.0)]
    assert ok(s, "data out; set a; if id > 1 then n + 1; run;", a=table("id", (1,), (2,), (3,))) == [(1, None), (2, 1.0), (3, 2.0)]
    assert ok(s, "data out; set a; seq + 1; run;", a=table("seq", (1.0,), (2.0,), (None,), (2.0,))) == [(2.0,), (3.0,), (1.0,), (3.0,)]
    groups = table("g x", ("b", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5))
    assert ok(s, "data out; set a; by g; if first.g then t = 0; t + x; if last.g; run;", a=groups) == [("a", 3, 5.0), ("b", 4, 5.0), (None, 5, 5.0)]
    assert ok(s, "data out; set a; by g; f = first.g; l = last.g; n = _n_; drop x; run;", a=groups) == [("a", True, False, 1.0), ("a", False, True, 2.0), ("b", True, False, 3.0), ("b", False, True, 4.0), (None, True, True, 5.0)]
    two = table("a b", (1, 1), (1, 2), (2, 2), (2, 3))
    assert ok(s, "data out; set t; by a b; f = first.b; l = last.b; run;", t=two) == [(1, 1, True, True), (1, 2, True, False), (2, 2, False, True), (2, 3, True, True)]
    assert ok(s, "data out; set a; if x > 1 then r = x; retain r; run;", a=table("x", (1,), (2,), (0,), (5,))) == [(1, None), (2, 2), (0, 2), (5, 5)]


def test_lags(s):
    t = table("x", (1,), (2,), (3,), (4,))
    assert ok(s, "data out; set t; where x > 1; a = lag(x); b = lead(x, 2, -1); c = shift('x', -3); run;", t=t) == [(2, 1, 4, None), (3, 2, -1, None), (4, 3, -1, 1)]


def test_set_and_merge(s):
    a, b = table("k x", (1, 10), (1, 11), (1, 12), (2, 20)), table("k y", (1, 100), (2, 200), (2, 201), (3, 300))
    assert ok(s, "data out; merge a(in=p) b(in=q); by k; i = p; j = q; run;", a=a, b=b) == [(1, 10, 100, 1, 1), (1, 11, 100, 1, 1), (1, 12, 100, 1, 1), (2, 20, 200, 1, 1), (2, 20, 201, 1, 1), (3, None, 300, 0, 1)]
    assert ok(s, "data out; merge a b end=e; if e; run;", a=a, b=b) == [(3, 20, 300)]
    assert ok(s, "data out; set a b indsname=d end=e; n = d; l = e; keep k n l; run;", a=a, b=b) == [(1, "a", 0), (1, "a", 0), (1, "a", 0), (2, "a", 0), (1, "b", 0), (2, "b", 0), (2, "b", 0), (3, "b", 1)]
    assert [r[0] for r in ok(s, "data out; set b a; by k; keep k; run;", a=a, b=b)] == [1, 1, 1, 1, 2, 2, 2, 3]
    assert ok(s, "data out; set a(keep=k x where=(x > 10 and not x is null) rename=(x=z) firstobs=2 obs=1); run;", a=a) == [(1, 12)]


def test_arrays(s):
    t = table("a b c", (1, 2, 3))
    assert ok(s, "data out; set t; array v[*] a b c; do i = 1 to 3; v[i] = v[i] * 2; end; n = dim(v); m = vname(v[2]); j = 3; x = v[j]; drop i j; run;", t=t) == [(2.0, 4.0, 6.0, 3.0, "b", 6.0)]


def test_stop_delete_and_order_of_statements(s):
    t = table("id", (1,), (2,), (3,))
    assert ok(s, "data out; set t; if id = 2 then stop; run;", t=t) == [(1,), (2,)]
    assert ok(s, "data out; set t; if id = 2 then delete; n + 1; run;", t=t) == [(1, 1.0), (3, 2.0)]


def test_row_loop(s):
    t = table("x", (1,), (2,), (3,), (4,))
    r = s.submit("data out; set t; a = lag(x * 2); b + x; if b > 3 then b = 0; run;", t=t)
    assert r and any(e.code == "RUNTIME_ROW_LOOP" for e in r.log)
    assert rows(s) == [(1, None, 1.0), (2, 2.0, 3.0), (3, 4.0, 0.0), (4, 6.0, 0.0)]
    s.set_option("retain_initial", True)
    assert ok(s, "data out; set t; retain f 1; f = f * x; run;", t=t) == [(1, 1.0), (2, 2.0), (3, 6.0), (4, 24.0)]


def test_string_functions(s):
    t = table("n", ("  Ann B. Cee ",))
    code = "data out; set t; a = substr(n,3,3); b = scan(n,2); c = compress(n,' .'); d = trim(n); e = upcase(n); f = propcase('aB cD'); g = lengthn(n); h = reverse('abc'); i = index(n,'B'); j = find(n,'b',1,'i'); k = tranwrd(n,'Ann','X'); l = translate('abc','xy','ab'); m = countw(n); o = catx('-',n,'',' q '); p = repeat('ab',2); q = cats(' a ',1.5); r = prxmatch('/b\\./i',n); u = prxchange('s/(a)(b)/$2$1/',1,'abab'); v = catt('a ','b'); drop n; run;"
    assert ok(s, code, t=t) == [("Ann", "B.", "AnnBCee", "Ann B. Cee", "  ANN B. CEE ", "Ab Cd", 13.0, "cba", 7.0, 7.0, "  X B. Cee ", "xyc", 3.0, "Ann B. Cee-q", "abab", "a1.5", 7.0, "baab", "ab")]


def test_formats(s):
    s.register_format("$sex.", {"M": "male"})
    s.register_informat("code.", {"x": 7})
    t = table("id v d sx", (5, 1234.5, "2024-03-09", "M"))
    code = "data out; set t; a = put(id, z4.); b = put(v, 8.1); c = put(v, comma10.2); e = put(input(d, yymmdd10.), yymmdd8.); f = put(sx, $sex.); g = input('x', code.); h = input(' 2.5 ', best.); i = put(v, best.); j = hour('10:30'); k = put(id, 8.); drop id v d sx; run;"
    assert ok(s, code, t=t) == [("0005", "1234.5", "1,234.50", "20240309", "male", 7.0, 2.5, "1234.5", 10.5, "5")]


def test_dates(s):
    t = table("m d y", (2, 29, 2024))
    assert ok(s, "data out; set t; y1 = year(mdy(m,d,y)); n = intck('day', mdy(1,1,2024), mdy(m,d,y)); k = intck('month', mdy(1,31,2023), mdy(m,d,y)); drop m d y; run;", t=t) == [(2024.0, 59.0, 13.0)]


def test_apply(s):
    def twice(x: float) -> float:
        return 2 * x

    assert s.submit("data out; set t; y = apply('twice', x); z = apply('max', x, 2); run;", t=table("x", (1,), (4,)))
    assert rows(s) == [(1, 2.0, 2.0), (4, 8.0, 4.0)]


def test_targets_labels_and_blocks(s):
    code = 'data a1(keep=id label="A") b1(drop=amount rename=(id=k) where=(id > 1)); set a; label id="The id"; output a1; output b1; run; data out; set a1; if id > 2; run;'
    r = s.submit(code, a=IN)
    assert r, r.render()
    assert rows(s, "a1") == [(1,), (2,), (3,)] and s["a1"].label == "A" and s["a1"].frame().schema["id"].metadata == {"label": "The id"}
    assert rows(s) == [(3,)]


@pytest.mark.parametrize(("code", "expected"), [
    ("data out; set nope; run;", "RUNTIME_SET_DATASET_NOT_FOUND"),
    ("data out; set a; keep zz; run;", "VALIDATE_COLUMN_NOT_FOUND"),
    ("data out; set a; rename zz = q; run;", "RUNTIME_RENAME_STATEMENT_INVALID"),
    ("data out out; set a; run;", "VALIDATE_DUPLICATE_DATA_TARGET"),
    ("data dictionary.x; set a; run;", "VALIDATE_RESERVED_OUTPUT_TARGET"),
    ("data out; set a; by zz; run;", "RUNTIME_BY_PRECONDITION_FAILED"),
    ("data out; set a; length x 8; run;", "RUNTIME_RUST_STATEMENT_UNSUPPORTED"),
    ("data out; set a; x = nofunc(1); run;", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    ("data out; set a(where=(abs(id) > 1)); run;", "PARSE_DATASET_WHERE_UNSUPPORTED"),
    ("data out; set a(end=e); run;", "PARSE_SET_OPTION_SCOPE_ERROR"),
    ("data out; merge a a2; by id; run;", "RUNTIME_MERGE_DUPLICATE_COLUMN"),
    ("data out; set a(in=amount); run;", "RUNTIME_INTERNAL_VAR_NAME_COLLISION"),
    ("data out; set a; frobnicate; run;", "PARSE_UNSUPPORTED_STATEMENT"),
    ("data out; set a; output other; run; data x; set a; if id then output zz; run;", "REQ_INVALID_OUTPUT_TARGETS"),
])
def test_diagnostics(s, code, expected):
    s.loads(a=IN, a2=IN)
    r = s.submit(code)
    assert not r and r.log[-1].code == expected and "out" not in s.datasets


def test_helpers(s):
    s.load("t", table("g n v", ("b", "x", 1), ("a", "y", None), ("b", "y", 3), ("a", "x", 4)))
    assert [r[0] for r in map(lambda d: tuple(d.values()), s.sort("t", [("g", "descending"), "v"], out="o").to_pylist())] == ["b", "b", "a", "a"]
    assert [tuple(r.values()) for r in s.sort("t", "g", out="o", nodupkey=True).to_pylist()] == [("a", "y", None), ("b", "x", 1)]
    assert [tuple(r.values()) for r in s.transpose("t", "g", "v", id="n", out="o").to_pylist()] == [("b", 1, 3), ("a", 4, None)]
    assert s.transpose("t", "g", "v", out="o").to_pylist() == [{"g": "b", "_NAME_": "v", "COL1": 1, "COL2": 3}, {"g": "a", "_NAME_": "v", "COL1": None, "COL2": 4}]
    assert s.select("t", "v g", out="o").columns == ["v", "g"] and s["t"].drop("v", out="o").columns == ["g", "n"]
    assert s["t"].where("v > 1", out="o").to_pylist() == [{"g": "b", "n": "y", "v": 3}, {"g": "a", "n": "x", "v": 4}]
    got = s.assign("t", out="o", u="upcase(g)", w="round(v / 3, 0.01)", c="case when v > 2 then 'big' when v > 0 then 'small' else 'none' end", k=7).to_pylist()
    assert [(r["u"], r["w"], r["c"], r["k"]) for r in got] == [("B", 0.33, "small", 7), ("A", None, "none", 7), ("B", 1.0, "big", 7), ("A", 1.33, "big", 7)]
    assert s.cast("t", {"v": "float64"}, out="o").to_pylist()[0]["v"] == 1.0


def test_sql(s):
    s.load("t", table("g v", ("a", 1), ("b", 2), ("a", 3)))
    s.sql("create table o as select g, sum(v) as v from t group by g")
    assert sorted(map(tuple, s.frame("o").collect())) == [("a", 4), ("b", 2)]
    assert s.sql("select count(*) as n from t x join o on x.g = o.g where x.g <> '{t}'").first()[0] == 3
    assert s.sql("select memname, nobs from dictionary.tables order by 1").collect()[1][1] == 3
    s.sql("drop table o")
    assert "o" not in s.datasets
    with pytest.raises(KeyError):
        s.sql("drop table o")


def test_formats_in_the_row_loop_are_those_of_columns(s, spark):
    s.register_format("grade", {1: "one", 2: "two"})
    s.register_format("$code", {"a": "Alpha"})
    s.register_informat("level", {"low": 1, "high": 9})
    made = ["put(x, 8.2)", "put(x, z8.1)", "put(x, comma12.2)", "put(x, best.)", "put(k, grade.)", "put(t, $code.)", "put(d, yymmdd10.)", "put(d, yymmdd6.)", "put(ts, e8601dt.)", "put(ts, time.)",
            "input(n, best.)", "input(lv, level.)", "input(dd, yymmdd8.)", "input(d6, yymmdd6.)", "input(tt, e8601dt.)", "hour(ts)", "hour(c)"]
    body = " ".join(f"r{i} = {e};" for i, e in enumerate(made))
    names = " ".join(f"r{i}" for i in range(len(made)))
    day = dt.datetime(2024, 3, 5, 14, 30, 15)
    data = table("x k t d ts n lv dd d6 tt c", (1234.565, 1, "a", day.date(), day, " 12.5 ", "low", "20240229", "240229", "2024-02-29T01:02:03", "10:45"), (-0.125, 3, "b", None, None, "", "none", "", "", "", None), (None, 2, None, day.date(), day, "7", "high", "19991231", "991231", "1999-12-31T23:59:59", "23:59:59"))
    plain = ok(s, f"data out; set a; {body} keep {names}; run;", a=data)
    looped = ok(s, f"data out; set a; {body} w = lag(x * 1); keep {names}; run;", a=data)
    assert looped == plain and len(plain) == 3


def test_module_level_run_sees_the_callers_functions(spark):
    from rowloom import session

    local = lambda x: x + 100.0
    r = session.run("data out; set a; p = apply('local', id); q = apply('abs', -id); keep p q; run;", spark, a=table("id", (1,), (2,)))
    assert r, r.render()
    assert local and [tuple(x) for x in r.datasets["out"].collect()] == [(101.0, 1.0), (102.0, 2.0)]


def test_filters_reach_the_scan(spark, s):
    s.load("l", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    for where, pushed in (("l_quantity > 25", "GreaterThan(l_quantity,25.0)"), ("l_quantity < 25", "LessThan(l_quantity,25.0)"), ("3 = l_linenumber", "EqualTo(l_linenumber,3)"), ("not (l_quantity >= 5) and l_returnflag > 'A'", "GreaterThan(l_returnflag,A)")):
        for code in (f"data out; set l; where {where}; keep l_orderkey; run;", f"data out; set l; if {where}; keep l_orderkey; run;"):
            assert s.submit(code)
            plan = s.frame("out")._jdf.queryExecution().toString()
            assert any("PushedFilters" in x and pushed[:20] in x for x in plan.split("\n")), (code, plan)


def test_rounding_halves(s):
    t = table("x", (0.49999999999999994,), (0.5,), (-0.5,), (2.5,), (-2.5,), (4503599627370497.0,), (1e300,))
    want = [(0.0,), (1.0,), (-1.0,), (3.0,), (-3.0,), (4503599627370497.0,), (1e300,)]
    assert ok(s, "data out; set t; y = round(x); keep y; run;", t=t) == want
    assert ok(s, "data out; set t; b + x; if b < 0 then b = 0; y = round(x); keep y; run;", t=t) == want  # by the row loop


def test_row_loop_by_group(s):
    t = table("g x", (2, 1), (1, 5), (1, 6), (2, 9), (1, 7), (None, 3), (2, 2))
    code = "data out; set t; by g; if first.g then do; b = 0; m = .; end; if x > 5 then m = x; b + x; if b > 10 then b = 0; retain m; run;"
    want = [(1, 5, 5.0, None), (1, 6, 0.0, 6), (1, 7, 7.0, 7), (2, 1, 1.0, None), (2, 9, 10.0, 9), (2, 2, 0.0, 9), (None, 3, 3.0, None)]
    assert [(r["g"], r["x"], r["b"], r["m"]) for r in (ok(s, code, t=t), s.to_pylist("out"))[1]] == want
    plan = s.frame("out")._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan and "SinglePartition" not in plan and "hashpartitioning(g" in plan
    assert ok(s, "data o2; set out; n = _n_; keep n; run;") is not None and [r["n"] for r in s.to_pylist("o2")] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    kept = ok(s, "data out; set t; by g; b + x; if first.g then b = 0; if b > 10 then b = 0; run;", t=t)  # set after its sum: one task, in order
    assert [r[2] for r in kept] == [0.0, 6.0, 0.0, 0.0, 9.0, 0.0, 0.0]


def test_lags_of_expressions(s):
    t = table("x", (1,), (2,), (3,), (4,))
    r = s.submit("data out; set t; if x > 1; a = x - lag(x * 10, 1, 0); run;", t=t)
    assert r and not any(e.code == "RUNTIME_ROW_LOOP" for e in r.log) and rows(s) == [(2, 2.0), (3, -17.0), (4, -26.0)]
    r = s.submit("data out; set t; if x > 2 then a = lag(x * 10); b = lag(x + 0, 2); run;", t=t)
    assert r and any(e.code == "RUNTIME_ROW_LOOP" for e in r.log) and rows(s) == [(1, None, None), (2, None, None), (3, None, 1.0), (4, 30.0, 2.0)]
    r = s.submit("data out; set t; a = lag(x * 1); b = lag(x * 2); run;", t=t)  # one queue a distance: the two share it
    assert r and rows(s) == [(1, None, 1.0), (2, 2.0, 2.0), (3, 4.0, 3.0), (4, 6.0, 4.0)]


def test_faults_in_rows_at_submit(s):
    t = table("x", ("1",), ("no",))
    code = "data one; set t; y = x; run;\ndata two; set one;\n  y = x + 1; run;"
    assert s.submit(code, t=t) and "two" in s.datasets
    s.unload("one", "two")
    s.set_option("check_outputs", True)
    r = s.submit(code, t=t)
    assert not r and r.log[-1].code == "RUNTIME_EXPRESSION_EVALUATION_ERROR" and "one" not in s.datasets and "two" not in s.datasets


def test_repeated_by_values_are_warned_of(s):
    s.set_option("check_outputs", True)
    a, b, c = table("k x", (1, 1), (1, 2)), table("k y", (1, 3), (1, 4)), table("k z", (1, 5), (2, 6))
    r = s.submit("data out; merge a b; by k; run;", a=a, b=b)
    assert r and [(e.level, e.code) for e in r.log] == [("warning", "RUNTIME_MERGE_REPEATED_BY_VALUES")] and rows(s) == [(1, 1, 3), (1, 2, 4)]
    assert not s.submit("data out; merge a c; by k; run;", a=a, c=c).log


def test_diagnostics_show_the_place(s, capsys):
    r = s.submit("data out;\n  set a;\n  rename x=y\n    x=z;\nrun;", a=IN)
    entry = r.log[-1]
    assert (entry.span.line, entry.span.column, entry.span.end_line) == (3, 3, 4) and entry.labels[0].span == entry.span
    text = r.render().split("\n")
    assert text[0].startswith("ERROR [RUNTIME_RENAME_STATEMENT_INVALID]") and text[2] == "    3 |   rename x=y" and text[3] == "      |   ^^^^^^^^^^"
    s.set_option("print_log", True)
    s.submit("data out; set nowhere; run;")
    assert "RUNTIME_SET_DATASET_NOT_FOUND" in capsys.readouterr().out
    quiet = s.submit("data out; set a; y = .; z = ''; run;", a=IN, display_result=False)
    assert repr(quiet) == "" and [n.id for n in quiet.notices] == ["COMPAT_MISSING_VALUE_SEMANTICS", "COMPAT_EMPTY_STRING_SEMANTICS"]


def test_order_of_spark_frames(spark, s):
    shuffled = spark.range(0, 500, 1, 5).selectExpr("id", "id % 7 as g").groupBy("g").count()
    s.load("t", shuffled)
    assert s.submit("data a; set t; n = _n_; run; data b; set t; n = _n_; run;")
    assert s.to_pylist("a") == s.to_pylist("b")
    s.load("k", spark.range(0, 50, 1, 5).selectExpr("50 - id as id"), order="id")
    assert s.submit("data c; set k; n = _n_; run;") and [r["id"] for r in s.to_pylist("c")] == list(range(1, 51))
    s.load("z", spark.range(20).selectExpr("id", "id % 3 as g").orderBy("g", "id"))
    assert [r["g"] for r in s.to_pylist("z")] == [0] * 7 + [1] * 7 + [2] * 6


def test_apply_finds_the_type(s):
    def shout(x):
        return x.upper()

    assert s.submit("data out; set t; y = apply('shout', x); run;", t=table("x", ("a",), ("b",))) and rows(s) == [("a", "A"), ("b", "B")]


def test_merge_with_a_unique_side_is_one_join(spark, s):
    a, b = table("k x", (1, 10), (None, 30), (2, 20)), table("k y", (2, 200), (1, 101), (2, 201), (3, 300), (None, 400), (2, 202))
    want = [(1, 10, 101, 1, 1), (2, 20, 200, 1, 1), (2, 20, 201, 1, 1), (2, 20, 202, 1, 1), (3, None, 300, 0, 1), (None, 30, 400, 1, 1)]
    assert ok(s, "data out; merge a(in=p) b(in=q); by k; i = p; j = q; run;", a=a, b=b) == want
    assert ok(s, "data out; merge b(in=q) a(in=p); by k; i = p; j = q; run;", a=a, b=b) == [(k, y, x, i, j) for k, x, y, i, j in want]
    assert ok(s, "data out; merge a(in=p) b(in=q); by k; if not p; n = _n_; f = first.k; run;", a=a, b=b) == [(3, None, 300, 5.0, True)]
    s.load("c", spark.read.parquet("/root/testdata/sf0.001/customer.parquet"))
    s.load("o", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    for test, kind in (("a and b", "Inner"), ("a", "LeftOuter"), ("b and not a", "RightOuter")):
        assert s.submit(f"data out; merge o(in=a keep=o_custkey o_orderkey rename=(o_custkey=k)) c(in=b keep=c_custkey c_name rename=(c_custkey=k)); by k; if {test}; run;")
        plan = s.frame("out")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and f"Join {kind}" in plan, plan


def test_metadata_survives(s):
    fields = [pa.field("k", pa.int64(), metadata={"label": "Key", "unit": "piece"}), pa.field("x", pa.float64())]
    s.load("a", pa.table({"k": [2, 1], "x": [1.0, None]}, schema=pa.schema(fields, {"memlabel": "All"})))
    assert s.submit("data b(label='Two'); set a(rename=(k=key)); y = x; label x='Measure'; run;")
    s.sort("b", "key", out="c")
    s.select("c", "key x", out="d")
    t = s.to_arrow("d")
    assert t.field("key").metadata == {b"label": b"Key", b"unit": b"piece"} and t.field("x").metadata == {b"label": b"Measure"} and t.to_pydict() == {"key": [1, 2], "x": [None, 1.0]}
    assert s.to_arrow("b").schema.metadata[b"memlabel"] == b"Two" and s.to_arrow("a").schema.metadata[b"memlabel"] == b"All"


def test_transpose_refuses_too_many_columns(s, monkeypatch):
    from rowloom.operators import helpers

    monkeypatch.setattr(helpers, "MOST_COLUMNS", 2)
    s.load("t", table("g n v", (1, "a", 1), (1, "b", 2), (1, "c", 3)))
    for kwargs in ({"id": "n"}, {}):
        with pytest.raises(ValueError, match="columns"):
            s.transpose("t", "g", "v", **kwargs)


def test_apply_of_whole_series(s):
    assert s.submit("data out; set t; y = apply('f', x, z); run;", t=table("x z", (1.0, 2.0), (3.0, None)), functions={"f": (lambda a, b: a + b.fillna(0), "double", True)})
    assert rows(s) == [(1.0, 2.0, 3.0), (3.0, None, 3.0)]


def exported(x):
    """The shortest rounding within 1e-12, relative above 1, halves away from zero."""
    if x is None or not math.isfinite(x):
        return x
    for p in range(14):
        y = abs(x) * 10.0**p
        whole = float(math.floor(y))
        rounded = (whole + (y - whole >= 0.5)) / 10.0**p
        if abs(rounded - abs(x)) <= 1e-12 * max(1.0, abs(x)):
            return math.copysign(rounded, x) + 0.0
    return x


def test_exported_doubles_round_halves_away_from_zero(s):
    rng = random.Random(3)
    given = [0.1234567890125, 1324101562.0285, 594362523.4485, 5e11 + 0.5, 500000000.0005, 2.0**52 + 1, 2.0**53 - 1, 2.0**63 + 2048, 1e300, math.inf, 0.0, 0.49999999999999994, 5e-13, 1.5e-12, 0.1 + 0.2, 1 / 3, None]
    given += [rng.randrange(10**13) / 10**13 for _ in range(300)] + [rng.randrange(5 * 10**12, 5 * 10**13) / 1e4 for _ in range(300)] + [rng.random() * 10.0 ** rng.randrange(-14, 20) for _ in range(300)]
    given += [-x for x in given if x is not None]
    s.load("a", pa.table({"x": given}))
    assert s.submit("data out; set a; run;")
    got = [x for (x,) in rows(s)]
    assert [repr(x) for x in got] == [repr(exported(x)) for x in given]
    assert got[:3] == [0.123456789013, 1324101562.029, 594362523.449]


def test_exp_of_columns_is_that_of_the_row_loop(s):
    rng = random.Random(3)
    given = [rng.uniform(-745, 709) for _ in range(1000)] + [0.0, 1.0, -1.0, 709.782712893384, 709.7827128933841, 800.0, -745.14, -800.0, math.inf, -math.inf]
    s = Session(s.spark, snap_floats=False)
    s.load("a", pa.table({"x": [*given, math.nan, None]}))
    assert s.submit("data out; set a; y = exp(x); keep y; run;")
    *got, nan, missing = [y for (y,) in rows(s)]
    want = [math.exp(x) if x < 709.7827128933841 else math.inf for x in given]
    assert got[1000:] == want[1000:] and math.isnan(nan) and missing == 1.0
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 10
    assert all(abs(a - b) <= math.ulp(b) for a, b in zip(got[:1000], want, strict=False))
