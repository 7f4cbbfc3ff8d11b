"""Scalar functions of step expressions, as columns. Each takes typed values; the tables give arity and builder."""

from __future__ import annotations

import re
from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .values import NAN, Value, refuse


def _int(c: Column) -> Column:
    return c.cast("int")


def _delimited(s: Column, delimiters: Value | None) -> Column:
    """Non-empty tokens of a text; every character of the delimiters splits."""
    if delimiters is None:
        return F.filter(F.split(s, " "), lambda x: x != "")
    if delimiters.is_literal:
        chars = str(delimiters.literal or "")
        pattern = "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in chars) + "]" if chars else "(?!)"
        return F.filter(F.split(s, pattern), lambda x: x != "")
    spaced = F.regexp_replace(s, F.concat(F.lit("["), F.regexp_replace(V.text(delimiters), r"([^A-Za-z0-9])", r"\\$1"), F.lit("]")), F.lit("\x01"))
    return F.filter(F.split(spaced, "\x01"), lambda x: x != "")


def substr(s, pos, size=None):
    t, p = V.text(s), F.greatest(_int(V.number0(pos)), F.lit(1))
    n = F.lit(2**31 - 1) if size is None else F.greatest(_int(V.number0(size)), F.lit(0))
    return Value(F.substring(t, p, n), "str")


def scan(s, n, dlm=None):
    k = _int(V.number0(n))
    return Value(F.when(k < 1, "").otherwise(F.coalesce(F.get(_delimited(V.text(s), dlm), k - 1), F.lit(""))), "str")


def compress(s, chars=None):
    return Value(V.remove_space(V.text(s)) if chars is None else F.translate(V.text(s), _chars(chars), ""), "str")


def _chars(v: Value):
    if not v.is_literal:
        raise refuse("the characters must be a literal")
    return str(v.literal if v.literal is not None else "")


def propcase(s):
    words = F.transform(F.split(F.lower(V.text(s)), r"(?<=\s)|(?=\s)"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return Value(F.array_join(words, ""), "str")


def length(s):
    return Value(F.char_length(V.text(s)).cast("double"), "num")


def index(s, sub):
    return Value(F.position(V.text(sub), V.text(s)).cast("double"), "num")


def find(s, sub, start=None, modifier=None):
    t, u = V.text(s), V.text(sub)
    if isinstance(start, Value) and start.type == "str" and modifier is None:
        start, modifier = None, start
    if modifier is not None and "i" in _chars(modifier).lower():
        t, u = F.lower(t), F.lower(u)
    at = F.lit(1) if start is None else F.greatest(_int(V.number0(start)), F.lit(1))
    empty = F.when(at <= F.char_length(t) + 1, at).otherwise(F.lit(0))
    return Value(F.when(u == "", empty).otherwise(F.position(u, t, at)).cast("double"), "num")


def translate(s, to, from_):
    new, old = _chars(to), _chars(from_)
    last = {c: new[i] if i < len(new) else "" for i, c in enumerate(old)}
    kept = [c for c in last if last[c]]
    gone = [c for c in last if not last[c]]
    return Value(F.translate(V.text(s), "".join(kept + gone), "".join(last[c] for c in kept)), "str")


def catx(d, *parts):
    return Value(F.array_join(F.filter(F.array(*[V.strip(V.text(p)) for p in parts]), lambda x: x != ""), _chars(d)), "str")


def logarithm(x, base=None):
    def ln(c: Column) -> Column:
        return F.when(c > 0, F.log(c)).when(c == 0, -V.INF).otherwise(NAN)

    c = V.number0(x)
    return Value(ln(c) if base is None else V.divide(ln(c), ln(V.number0(base))), "num")


STEPS = 128  # of exponential(): powers of 2 by 1/128, each as the sum of two doubles, and the width of a step in two parts
with localcontext() as _digits:
    _digits.prec = 50
    _STEP = Decimal(2).ln() / STEPS
    STEP_HIGH = round(_STEP * 2**42) / 2.0**42  # 35 bits, so that products with whole numbers below 2^18 are exact
    STEP_LOW = float(_STEP - Decimal(STEP_HIGH))
    _POWERS = [(_STEP * i).exp() for i in range(STEPS)]
    POWERS_HIGH = [float(p) for p in _POWERS]
    POWERS_LOW = [float(p - Decimal(h)) for p, h in zip(_POWERS, POWERS_HIGH, strict=True)]


def exponential(x):
    """The nearest double but for about one value in 800 (of Java's own, one in ten), so nearly always that of the row loop's C library."""

    def picked(table: list[float]) -> Column:
        return F.get(F.expr(f"array({', '.join(f'{p!r}D' for p in table)})"), _int(F.pmod(k, F.lit(float(STEPS)))))

    c = V.number0(x)
    near = F.least(F.greatest(c, F.lit(-746.0)), F.lit(710.0))  # beyond, the result is 0 or infinite
    k = F.rint(near / float(_STEP))
    rest = (near - k * STEP_HIGH) - k * STEP_LOW
    high, twos, half = picked(POWERS_HIGH), F.floor(k / STEPS), F.floor(k / (2 * STEPS))
    out = (high + (high * F.expm1(rest) + picked(POWERS_LOW))) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), twos - half)
    return Value(F.when(F.isnan(c), c).otherwise(out), "num")


def rounded(x, unit=None):
    c = V.number0(x)
    u = F.lit(1.0) if unit is None else V.number0(unit)
    q = F.try_divide(c, u)
    return Value(F.when(F.abs(u) < V.EPSILON, c).otherwise(V.half_away(q) * u).cast("double"), "num")


def _truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def _present(vs) -> list[Column]:
    return [F.when(V.missing(v), None).otherwise(V.number(v)) for v in vs]


def extreme(pick):
    def build(*vs):
        cols = _present(vs)
        return Value(F.lit(None).cast("double") if not cols else cols[0] if len(cols) == 1 else pick(*cols), "num")

    return build


def total(*vs):
    return Value(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in _present(vs)], F.lit(0.0)), "num")


def mean(*vs):
    cols = _present(vs)
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in cols], F.lit(0.0))
    return Value(F.when(count == 0, NAN).otherwise(F.try_divide(total(*vs).col, count)), "num")


def count_missing(*vs):
    return Value(reduce(lambda a, b: a + b, [V.missing(v).cast("double") for v in vs], F.lit(0.0)), "num")


def mdy(m, d, y):
    return Value(F.make_date(*[_int(V.number(v)) for v in (y, m, d)]), "date")


def as_date(v: Value) -> Column:
    if v.type == "str":
        return F.to_date(F.substring(v.col, 1, 10))
    if v.type in ("date", "ts", "null"):
        return v.col.cast("date")
    raise refuse("a date is needed")


def year(d):
    return Value(F.year(as_date(d)).cast("double"), "num")


def intck(unit, a, b):
    name, x, y = _chars(unit).lower(), as_date(a), as_date(b)
    if name == "day":
        out = F.date_diff(y, x)
    elif name == "month":
        out = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    elif name == "year":
        out = F.year(y) - F.year(x)
    else:
        raise refuse(f"unsupported interval: {name}")
    return Value(out.cast("double"), "num")


def _pattern(written: str) -> str:
    m = re.fullmatch(r"/(.*)/([a-z]*)", written, re.S)
    body, flags = (m[1], m[2]) if m else (written, "")
    if set(flags) - set("imsx"):
        raise refuse(f"unsupported pattern flags: {flags}")
    used = "".join(f for f in flags if f in "ims")
    try:
        re.compile(body)
    except re.error as e:
        raise refuse(f"invalid pattern: {e}") from None
    return (f"(?{used})" if used else "") + body


def prxmatch(pattern, s):
    p, t = _pattern(_chars(pattern)), V.text(s)
    return Value(F.regexp_instr(t, F.lit(p)).cast("double"), "num")


def prxchange(pattern, times, s):
    m = re.fullmatch(r"s/(.*?)/(.*?)/([a-z]*)", _chars(pattern), re.S)
    if not m:
        raise refuse("prxchange needs s/pattern/text/flags")
    if not times.is_literal or not isinstance(times.literal, (int, float)):
        raise refuse("the number of changes must be a literal")
    p, t = _pattern(f"/{m[1]}/{m[3]}"), V.text(s)
    if times.literal <= 0:
        return Value(F.regexp_replace(t, p, m[2]), "str")
    if re.match(r"\(\?[ims]*\)", p):
        flags, p = p[: p.index(")") + 1], p[p.index(")") + 1 :]
    else:
        flags = ""
    shifted = re.sub(r"\$(\d+)", lambda g: f"${int(g[1]) + 1}", m[2])
    for _ in range(int(times.literal)):  # one at a time, on the text changed before
        t = F.regexp_replace(t, rf"{flags}\A((?s:(?!{p}).)*)(?:{p})", "$1" + shifted)
    return Value(t, "str")


def _text1(f):
    return lambda s: Value(f(V.text(s)), "str")


def _num1(f):
    return lambda x: Value(f(V.number0(x)).cast("double"), "num")


def _cat(f):
    return lambda *ps: Value(F.concat(F.lit(""), *[f(V.text(p)) for p in ps]), "str")


MANY = 10**6
# name: (least arguments, most arguments, builder)
FUNCTIONS = {
    "substr": (2, 3, substr), "scan": (2, 3, scan), "compress": (1, 2, compress), "trim": (1, 1, _text1(V.strip)), "strip": (1, 1, _text1(V.strip)),
    "upcase": (1, 1, _text1(F.upper)), "lowcase": (1, 1, _text1(F.lower)), "propcase": (1, 1, propcase), "length": (1, 1, length), "lengthn": (1, 1, length),
    "reverse": (1, 1, _text1(F.reverse)), "index": (2, 2, index), "find": (2, 4, find), "translate": (3, 3, translate),
    "tranwrd": (3, 3, lambda s, a, b: Value(F.replace(V.text(s), V.text(a), V.text(b)), "str")),
    "countw": (1, 2, lambda s, d=None: Value(F.size(_delimited(V.strip(V.text(s)), d)).cast("double"), "num")),
    "cat": (1, MANY, _cat(lambda c: c)), "cats": (1, MANY, _cat(V.strip)), "catt": (1, MANY, _cat(V.strip_right)), "catx": (2, MANY, catx),
    "repeat": (2, 2, lambda s, n: Value(F.repeat(V.text(s), _int(V.number0(n))), "str")),
    "abs": (1, 1, _num1(F.abs)), "ceil": (1, 1, _num1(F.ceil)), "floor": (1, 1, _num1(F.floor)), "int": (1, 1, _num1(_truncate)), "sqrt": (1, 1, _num1(F.sqrt)),
    "exp": (1, 1, exponential), "sign": (1, 1, _num1(F.signum)), "log": (1, 2, logarithm), "round": (1, 2, rounded),
    "pow": (2, 2, lambda a, b: Value(F.pow(V.number(a), V.number(b)), "num")), "mod": (2, 2, lambda a, b: Value(V.modulo(V.number(a), V.number(b)), "num")),
    "max": (0, MANY, extreme(F.greatest)), "min": (0, MANY, extreme(F.least)), "sum": (0, MANY, total), "mean": (0, MANY, mean),
    "missing": (1, 1, lambda v: Value(V.missing(v), "bool")), "nmiss": (0, MANY, count_missing), "cmiss": (0, MANY, count_missing),
    "mdy": (3, 3, mdy), "year": (1, 1, year), "intck": (3, 3, intck), "prxmatch": (2, 2, prxmatch), "prxchange": (3, 3, prxchange),
}


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise refuse(f"unsupported function: {name}")
    least, most, build = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise refuse(f"{name} takes {least}" + (f" to {most}" if most != least else "") + f" arguments, not {len(args)}")
    for a in args:
        V.nested(a)
    return build(*args)
