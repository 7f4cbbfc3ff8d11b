"""One case of our own for each kind of step that the blueprint's fixtures list: inputs, program, rows of each output."""

import datetime as dt
import math

import pytest

from rowloom.session import Session


def table(columns, *values):
    return [dict(zip(columns.split(), v, strict=True)) for v in values]


ID3 = table("id", (1,), (2,), (3,))
AMOUNTS = table("id amount tmp", (1, 5, "x"), (2, 15, "y"), (3, 25, "z"))
A, B = table("id x", (1, 10), (2, 20), (2, 21)), table("id y", (2, 200), (3, 300))
NAN = "nan"

CASES = {
    # aggregate
    "if_do_sum_retain": ({"a": table("id", (1,), (2,))}, "data out; set a; if id = 2 then do; flag + 1; end; run;", {"out": [(1, None), (2, 1.0)]}),
    "sum_statement_accumulation": ({"a": ID3}, "data out; set a; seq + id; run;", {"out": [(1, 1.0), (2, 3.0), (3, 6.0)]}),
    "sum_source_with_missing": ({"a": table("seq", (1.0,), (2.0,), (None,), (2.0,))}, "data out; set a; seq + 1; run;", {"out": [(2.0,), (3.0,), (1.0,), (3.0,)]}),
    "sum_missing_increment": ({"a": table("seq", (3.0,), (3.0,))}, "data out; set a; seq + .; run;", {"out": [(3.0,), (3.0,)]}),
    "sum_case_variants": ({"a": table("seq", (1.0,), (1.0,))}, "data out; set a; SEQ + 1; seq + 1; run;", {"out": [(3.0,), (3.0,)]}),
    # array
    "array_assignment_dim_vname": ({"a": table("p q r", (1, 2, 3))}, "data out; set a; array v[3] p q r; v[2] = v[1] + v[3]; n = dim(v); m = vname(v[3]); run;", {"out": [(1, 4.0, 3, 3.0, "r")]}),
    "array_star_dimension_index_access": ({"a": table("p q", (7, 8))}, "data out; set a; array v[*] p q; n = dim(v); i = 2; x = v{i} - v(1); keep n x; run;", {"out": [(2.0, 1.0)]}),
    # automatic variables
    "concat_and_n": ({"a": table("pre id suf", ("p", 1, None), (None, 2, "s"))}, "data out; set a; j = pre || id || suf; r = _n_; keep j r; run;", {"out": [("p1", 1.0), ("2s", 2.0)]}),
    "auto_variables_any_case": ({"a": table("id", (9,), (8,))}, "data out; set a; u = _N_; l = _n_; e = _Error_; keep u l e; run;", {"out": [(1.0, 1.0, 0.0), (2.0, 2.0, 0.0)]}),
    "first_last_by_group_flags": ({"a": table("g id", ("b", 1), ("a", 2), ("b", 3))}, "data out; set a; by g; f = first.g; l = last.g; run;", {"out": [("a", 2, True, True), ("b", 1, True, False), ("b", 3, False, True)]}),
    # control flow
    "do_end_loop": ({"a": table("id", (4,))}, "data out; set a; do i = 1 to 3; times = i * id; output; end; drop i; run;", {"out": [(4, 4.0), (4, 8.0), (4, 12.0)]}),
    "multi_block_chain": ({"a": ID3}, "data one; set a; if id > 1; run; data two; set one; if id < 3; run;", {"one": [(2,), (3,)], "two": [(2,)]}),
    "stop_behavior": ({"a": ID3}, "data out; set a; if id = 2 then stop; run;", {"out": [(1,), (2,)]}),
    "if_then_do_else_do": ({"s": table("name age", ("u", 11), ("v", 14), ("w", 12), ("x", 15))}, "data y o; set s; if age < 13 then do; seq = 1; output y; end; else do; seq = 2; output o; end; run;", {"y": [("u", 11, 1), ("w", 12, 1)], "o": [("v", 14, 2), ("x", 15, 2)]}),
    "runtime_if_else_multi_output": ({"a": AMOUNTS}, "data hi lo; set a; if amount > 10 then output hi; else output lo; keep id amount; run;", {"hi": [(2, 15), (3, 25)], "lo": [(1, 5)]}),
    "runtime_do_assign_sum": ({"a": table("id amount", (1, 2), (2, 3))}, "data out; set a; total + amount; do i = 1 to 2; calc = amount * i; output; end; run;", {"out": [(1, 2, 2.0, 1, 2.0), (1, 2, 2.0, 2, 4.0), (2, 3, 5.0, 1, 3.0), (2, 3, 5.0, 2, 6.0)]}),
    "runtime_if_multi_output_power": ({"a": table("id age height weight", (1, 12, 50.0, 100.0), (2, 15, 60.0, 120.0))}, "data older younger; set a; m = height * 0.5; bmi = round(weight / m ** 2, 0.01); if age > 13 then output older; else output younger; keep id bmi; run;", {"older": [(2, 0.13)], "younger": [(1, 0.16)]}),
    # functions
    "formatting_put_input_hour": (
        {"a": table("id amount b d t c", (7, 1234.567, "2.50", "20240309", "2024-03-09T10:30:00", "06:45"))},
        "data out; set a; p = put(id, z4.); q = put(amount, 8.2); r = put(amount, comma9.1); s = input(b, best.); u = put(input(d, yymmdd8.), yymmdd10.); v = put(input(t, e8601dt.), e8601da.); w = hour(c); keep p q r s u v w; run;",
        {"out": [("0007", "1234.57", "1,234.6", 2.5, "2024-03-09", "2024-03-09", 6.75)]},
    ),
    "numeric_scalar_core": ({"a": table("x", (4,), (-1,))}, "data out; set a; i = int(x / 3); s = sum(x, ., 1); m = mean(x, 2); q = sqrt(x); l = log(x); e = round(exp(x), 0.001); g = sign(x); drop x; run;", {"out": [(1.0, 5.0, 3.0, 2.0, math.log(4), 54.598, 1.0), (0.0, 0.0, 0.5, NAN, NAN, 0.368, -1.0)]}),
    "string_functions_scalar_matrix": (
        {"a": table("n", (" jo ann ",))},
        "data out; set a; a = propcase(n); b = cat(n, 1); c = cats(n, 1); d = catt(n, 1); e = catx('+', n, ' ', 2); f = index(n, 'a'); g = find(n, 'N', 1, 'i'); h = tranwrd(n, 'n', 'N'); i = translate(n, 'xy', 'jo'); j = length(n); k = strip(n); l = reverse('ab'); m = repeat('x', 3); drop n; run;",
        {"out": [(" Jo Ann ", " jo ann 1", "jo ann1", " jo ann1", "jo ann+2", 5.0, 6.0, " jo aNN ", " xy ann ", 8.0, "jo ann", "ba", "xxx")]},
    ),
    "unicode_positions": ({"a": table("n", ("日本語é🙂x",))}, "data out; set a; a = lengthn(n); b = substr(n, 3, 2); c = index(n, 'x'); d = reverse(substr(n, 1, 2)); e = find(n, '🙂'); f = scan('日 本', 2); drop n; run;", {"out": [(7.0, "語e", 7.0, "本日", 6.0, "本")]}),
    "string_functions_regex": ({"a": table("n", ("Alpha beta",), ("none",))}, "data out; set a; a = prxmatch('/beta/', n); b = prxmatch('/ALPHA/i', n); c = prxchange('s/a(.)/<$1>/', -1, n); drop n; run;", {"out": [(7.0, 1.0, "Alph< >bet" + "a"), (0.0, 0.0, "none")]}),
    "string_functions_nullability": ({"a": table("n x", (None, 1), ("", None))}, "data out; set a; y = cmiss(n, x, 'z'); keep y; run;", {"out": [(1.0,), (2.0,)]}),
    # merge
    "merge_dataset_where_options": ({"l": A, "r": B}, "data out; merge l(where=(x >= 20) rename=(x=lv)) r(rename=(y=rv) where=(y < 300)); by id; run;", {"out": [(2, 20, 200), (2, 21, 200)]}),
    "merge_option_chain": ({"a": AMOUNTS}, "data out; merge a(keep=id amount tmp drop=tmp where=(amount > 5) rename=(amount=amt) firstobs=2 obs=1); by id; run;", {"out": [(3, 25)]}),
    "merge_statement_end_option": ({"a": A, "b": B}, "data out; merge a b end=e; by id; if e; keep id; run;", {"out": [(3,)]}),
    "merge_first_last_flags": ({"a": A, "b": B}, "data out; merge a b; by id; if first.id or last.id; f = First.ID; l = LAST.id; keep id f l; run;", {"out": [(1, True, True), (2, True, False), (2, False, True), (3, True, True)]}),
    "merge_occurrence_alignment": ({"l": table("k left", (1, 10), (1, 11), (1, 12), (2, 20)), "r": table("k right", (1, 100), (2, 200), (2, 201))}, "data out; merge l r; by k; run;", {"out": [(1, 10, 100), (1, 11, 100), (1, 12, 100), (2, 20, 200), (2, 20, 201)]}),
    # output
    "output_options_multi_target": ({"a": table("id name x tmp", (1, "p", 3, "t"), (2, "q", 9, "t"))}, "data one(keep=id where=(id = 1)) two(drop=tmp x rename=(name=full_name) where=(id = 2)); set a; output; run;", {"one": [(1,)], "two": [(2, "q")]}),
    "output_e2e_multi_output": ({"a": AMOUNTS}, "data p q; set a(drop=tmp); if amount < 10 then output p; if amount > 20 then output q; run;", {"p": [(1, 5)], "q": [(3, 25)]}),
    # missing values
    "missing_literals": ({"a": table("id", (1,), (2,))}, "data out; set a; if id = 1 then do; p = .; q = none; r = ''; end; else do; p = 1; q = 2; r = 'x'; end; s = missing(p) + missing(r); run;", {"out": [(1, None, None, "", 2.0), (2, 1, 2, "x", 0.0)]}),
    "missing_comparisons": ({"a": table("id", (1,))}, "data out; set a; a = . = .; b = . = 1; c = 1 > .; d = . >= .; drop id; run;", {"out": [(True, False, True, True)]}),
    # set
    "set_by_interleave_numeric": ({"a": table("id s", (1, "a"), (3, "a"), (3, "A")), "b": table("id s", (2, "b"), (3, "b"))}, "data out; set b a; by id; run;", {"out": [(1, "a"), (2, "b"), (3, "b"), (3, "a"), (3, "A")]}),
    "set_by_interleave_string": ({"a": table("n g", ("é", "a"), ("z", "a")), "b": table("n g", ("Z", "b"), (None, "b"))}, "data out; set a b; by n; run;", {"out": [("Z", "b"), ("z", "a"), ("é", "a"), (None, "b")]}),
    "dataset_options_order": ({"a": AMOUNTS}, "data out; set a(obs=1 firstobs=2 rename=(amount=amt) where=(amount >= 5) drop=tmp keep=id amount tmp); run;", {"out": [(2, 15)]}),
    "set_in_flag_subset": ({"a": ID3, "b": ID3}, "data out; set a(in=p) b(in=q); if q and id > 1; run;", {"out": [(2,), (3,)]}),
    "set_multi_input_order": ({"a": ID3[:1], "b": ID3[1:], "c": ID3[:1]}, "data out; set c b a; run;", {"out": [(1,), (2,), (3,), (1,)]}),
    "by_rename_internal_cleanup": ({"a": table("grp amount", ("x", 1), ("x", 2), ("y", 5))}, "data out; set a(rename=(amount=value)); by grp; if last.grp; keep grp value first.grp; run;", {"out": [("x", 2), ("y", 5)]}),
    "statement_options_end_flag": ({"a": ID3[:1], "b": ID3[1:]}, "data out; set a b end=done; if done; run;", {"out": [(3,)]}),
    "work_prefix_in_output_targets": ({"a": ID3}, "data work.out; set WORK.a; if id = 1; run;", {"work.OUT": [(1,)], "out": [(1,)]}),
    # where
    "basic_filtering": ({"a": table("n s", ("p", "F"), ("q", "M"), ("r", "F"))}, "data out; set a; where s = 'F'; run;", {"out": [("p", "F"), ("r", "F")]}),
    "builtin_predicates": ({"a": table("id d note", (1, -5, None), (2, 5, None), (3, -1, None))}, "data out; set a; where abs(d) >= 5 and missing(note) and sign(d) < 0; run;", {"out": [(1, -5, None)]}),
    "date_functions": ({"a": table("id m d y", (1, 2, 28, 2024), (2, 3, 1, 2023))}, "data out; set a; where year(mdy(m, d, y)) = 2024 and intck('day', mdy(m, d, y), mdy(3, 1, 2024)) = 2; run;", {"out": [(1, 2, 28, 2024)]}),
    "function_expressions": ({"a": table("n", ("ab",), ("abc",))}, "data out; set a; where lengthn(n) = 3 and upcase(substr(n, 1, 1)) = 'A'; run;", {"out": [("abc",)]}),
    "logical_conditions": ({"a": table("n", ("p",), ("q",), ("r",))}, "data out; set a; where (n = 'p' or n = 'q') and not (n = 'q'); run;", {"out": [("p",)]}),
    "subset_if_delete_equivalent": ({"a": AMOUNTS}, "data out; set a; if amount < 10 then delete; keep id; run; data same; set a; if amount >= 10; keep id; run;", {"out": [(2,), (3,)], "same": [(2,), (3,)]}),
    "runtime_arithmetic_logical_where": ({"a": table("id amount qty g", (1, 10, 2, "x"), (2, 10, 5, "x"), (3, 30, 5, "y"))}, "data out; set a; where amount * qty >= 50 and (g = 'x' or qty / 0 < 1); run;", {"out": [(2, 10, 5, "x")]}),
    "statement_where_multi_set": ({"a": A, "b": table("id x", (5, 1), (6, 30))}, "data out; set a b; where x > 10; run;", {"out": [(2, 20), (2, 21), (6, 30)]}),
    "statement_where_merge": ({"a": A, "b": B}, "data out; merge a b; by id; where y >= 200; run;", {"out": [(2, 20, 200), (2, 21, 200), (3, None, 300)]}),
    "string_native_functions": ({"a": table("id name path", (1, " x ", "a/b/c"), (2, "y", "a"))}, "data out; set a; where scan(path, 3, '/') = 'c' and strip(name) = 'x' and countw(path, '/') = 3; keep id; run;", {"out": [(1,)]}),
    "window_offsets_lag": ({"a": ID3}, "data out; set a; where lag(id) = 1; run;", {"out": [(2,)]}),
    "window_offsets_shift_source": ({"a": ID3}, "data out; set a; where shift('id', 1) = 3; run;", {"out": [(2,)]}),
    "window_offsets_shift_value": ({"a": ID3}, "data out; set a; p = shift(id, -1); if p = 2; run;", {"out": [(3, 2)]}),
    # exact integers
    "integer_fidelity": ({"a": table("k v", (2**53 + 1, None), (-(2**63), 2**63 - 1))}, "data out; set a; w = v; run;", {"out": [(2**53 + 1, None, None), (-(2**63), 2**63 - 1, 2**63 - 1)]}),
    "labels": ({"a": ID3[:1]}, "data out(label='All'); set a; label id='Number'; run;", {"out": [(1,)]}),
}


@pytest.mark.parametrize("name", list(CASES))
def test_pack(spark, name):
    inputs, code, outputs = CASES[name]
    s = Session(spark)
    r = s.submit(code, **inputs)
    assert r, r.render()
    for target, want in outputs.items():
        got = [tuple(NAN if isinstance(x, float) and math.isnan(x) else x for x in row.values()) for row in s.to_pylist(target)]
        assert got == [tuple(pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in row) for row in want], (name, got)


REFUSED = {
    "invalid_syntax": ("data out; set a; wher id = 1; run;", "parse", "PARSE_UNSUPPORTED_STATEMENT"),
    "set_in_statement_scope": ("data out; set a in=x; run;", "parse", "PARSE_UNSUPPORTED_STATEMENT"),
    "set_indsname_dataset_scope": ("data out; set a(indsname=x); run;", "parse", "PARSE_SET_OPTION_SCOPE_ERROR"),
    "merge_indsname_statement_scope": ("data out; merge a b indsname=x; by id; run;", "parse", "PARSE_SET_OPTION_SCOPE_ERROR"),
    "invalid_output_targets": ("data out; set a; if id = 1 then output other; run;", "resolve outputs", "REQ_INVALID_OUTPUT_TARGETS"),
    "set_dataset_not_found": ("data out; set zzz; run;", "validate", "RUNTIME_SET_DATASET_NOT_FOUND"),
    "dataset_where_invalid": ("data out; set a(where=(id >)); run;", "parse", "PARSE_DATASET_WHERE_UNSUPPORTED"),
    "operator_not_supported": ("data out; set a; x = id eq 1; run;", None, None),
    "invalid_regex": ("data out; set a; x = prxmatch('/(/', 'a'); run;", "execute", "RUNTIME_EXPRESSION_EVALUATION_ERROR"),
    "merge_by_precondition_failed": ("data out; merge a t; by id; run;", None, "RUNTIME_BY_PRECONDITION_FAILED"),
    "merge_duplicate_column": ("data out; merge a(rename=(x=y)) b; by id; run;", "pre-evaluations", "RUNTIME_MERGE_DUPLICATE_COLUMN"),
    "first_last_collision": ("data out; set f; by id; x = 1; run;", "pre-evaluations", "RUNTIME_INTERNAL_VAR_NAME_COLLISION"),
    "reserved_dictionary_output_target": ("data dictionary.tables; set a; run;", "validate", "VALIDATE_RESERVED_OUTPUT_TARGET"),
    "keep_unknown_column": ("data out; set a; keep zz; run;", "validate", "VALIDATE_COLUMN_NOT_FOUND"),
    "drop_unknown_column": ("data out; set a; drop zz; run;", "validate", "VALIDATE_COLUMN_NOT_FOUND"),
    "rename_unknown_column": ("data out; set a; rename zz=yy; run;", "validate", "RUNTIME_RENAME_STATEMENT_INVALID"),
    "label_unknown_column": ("data out; set a; label zz='z'; run;", "validate", "VALIDATE_COLUMN_NOT_FOUND"),
    "by_unknown_column": ("data out; set a b; by zz; run;", None, "RUNTIME_BY_PRECONDITION_FAILED"),
}


@pytest.mark.parametrize("name", list(REFUSED))
def test_refused_pack(spark, name):
    code, stage, wanted = REFUSED[name]
    s = Session(spark, check_outputs=True)
    s.loads({"a": A, "b": B, "t": table("id z", ("1", 1)), "f": [{"id": 1, "first.id": 1}]})
    r = s.submit(code)
    assert not r and "out" not in s.datasets
    entry = [e for e in r.log if e.level == "error"][-1]
    assert (stage is None or entry.stage == stage) and (wanted is None or entry.code == wanted), str(entry)


def test_dates_and_times(spark):
    s = Session(spark)
    s.load("a", [{"d": dt.date(2024, 2, 29), "t": dt.datetime(2024, 2, 29, 13, 45, 30)}])
    assert s.submit("data out; set a; y = year(d); z = year(t); h = hour(t); n = intck('month', d, mdy(1, 1, 2025)); e = d < mdy(3, 1, 2024); keep y z h n e; run;")
    assert [tuple(r.values()) for r in s.to_pylist("out")] == [(2024.0, 2024.0, pytest.approx(13.758333333333333), 11.0, True)]


def test_time_columns(spark):
    import pyarrow as pa

    s = Session(spark)
    times = [dt.time(10, 30), None, dt.time(23, 59, 59)]
    s.load("a", pa.table({"t": pa.array(times, pa.time64("us")), "id": [1, 2, 3]}))
    assert s.submit("data out; set a; h = hour(t); p = put(t, time.); q = cat(t); m = missing(t); e = t = t; g = lag(t) < t; run;")
    got = [tuple(r.values()) for r in s.to_pylist("out")]
    assert got == [(times[0], 1, 10.5, "10:30:00", "10:30:00", False, True, False), (None, 2, None, None, "", True, True, False), (times[2], 3, pytest.approx(23.999722222), "23:59:59", "23:59:59", False, True, False)]
    s.sort("a", [("t", "descending")], out="b")
    assert [r["id"] for r in s.to_pylist("b")] == [3, 1, 2]
    assert s.submit("data c; set a; by t; f = first.t; keep id f; run;") and [r["id"] for r in s.to_pylist("c")] == [1, 3, 2]
    assert not s.submit("data d; set a; x = t + 1; run;") and not s.submit("data d; set a; x = t < 5; run;")
    assert s.submit("data d; set a; b + id; if b > 2 then b = 0; drop t; run;").log[-1].code == "RUNTIME_EXPRESSION_EVALUATION_ERROR"
