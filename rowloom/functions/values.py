"""Typed columns and the coercions of step expressions (missing values count as 0, '' or false where a rule says so)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..diagnostics import StepError

EPSILON = 2.220446049250313e-16
NAN, INF = float("nan"), float("inf")
NUMERIC = ("int", "num", "bool", "null")
SPARK_TYPE = {"int": "bigint", "num": "double", "bool": "boolean", "str": "string", "date": "date", "ts": "timestamp", "time": "time(6)", "null": "void"}
_SPACE = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Value:
    col: Column
    type: str  # null int num bool str date ts time other
    literal: object = None
    is_literal: bool = False
    sure: bool = False  # a boolean that is never missing


def type_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    for base, name in ((T.BooleanType, "bool"), (T.StringType, "str"), (T.DateType, "date"), (T.TimestampType, "ts"), (T.TimestampNTZType, "ts"), (T.TimeType, "time"), (T.NullType, "null")):
        if isinstance(kind, base):
            return name
    return "other"


def lit(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), "null", None, True)
    kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "num" if isinstance(x, float) else "str"
    if kind == "int" and not -(2**63) <= x < 2**63:
        return Value(F.lit(float(x)), "num", float(x), True)
    return Value(F.lit(x), kind, x, True)


def refuse(message: str) -> StepError:
    return StepError("RUNTIME_EXPRESSION_EVALUATION_ERROR", message, "execute")


def nested(v: Value) -> None:
    if v.type == "other":
        raise refuse("nested values can't be used in expressions")


def join(a: str, b: str) -> str:
    """Type of a column that takes values of both types."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} == {"int", "num"}:
        return "num"
    raise refuse(f"a column can't hold both {a} and {b} values")


def cast(v: Value, kind: str) -> Column:
    return v.col if v.type == kind else v.col.cast(SPARK_TYPE[kind]) if kind in SPARK_TYPE and kind != "null" else v.col


def number(v: Value) -> Column:
    """As double; missing stays missing; text must be a plain number."""
    nested(v)
    if v.type == "str":
        plain = v.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return F.when(v.col.isNull(), None).when(plain, v.col.try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), v.col)).cast("double"))
    if v.type in ("date", "ts", "time"):
        raise refuse("a date or time is not a number")
    return v.col.cast("double")


def number0(v: Value) -> Column:
    return F.coalesce(number(v), F.lit(0.0))


def number_text(x: Column) -> Column:
    """A double without exponent, and without decimals where it is whole."""
    whole = (F.floor(x).cast("double") == x) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    special = F.when(F.isnan(x), "NaN").when(x == INF, "inf").when(x == -INF, "-inf")
    return F.when(F.isnan(x) | (F.abs(x) == INF), special).when(whole, x.cast("bigint").cast("string")).otherwise(plain)


def raw_text(v: Value) -> Column:
    """As text; missing stays missing."""
    nested(v)
    if v.type == "num":
        return number_text(v.col.cast("double"))
    if v.type == "ts":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col.cast("string")


def text(v: Value) -> Column:
    return F.coalesce(raw_text(v), F.lit(""))


def boolean(v: Value) -> Column:
    nested(v)
    if v.sure:
        return v.col
    if v.type == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.type in ("int", "num"):
        return F.coalesce(F.abs(v.col) >= EPSILON, F.lit(False))
    if v.type == "str":
        return F.coalesce(v.col != "", F.lit(False))
    return F.lit(False) if v.type == "null" else v.col.isNotNull()


def missing(v: Value) -> Column:
    return v.col.isNull() | (v.col == "") if v.type == "str" else v.col.isNull()


def _against(op: str, a: Value, b: Value) -> Column | None:
    """A numeric column against a numeric literal, as filters of a scan can have it: the column itself is compared, and missing counts as 0."""
    if a.is_literal or not b.is_literal or a.type not in ("int", "num") or b.type not in ("int", "num"):
        return None
    x = b.literal
    if a.type == "int":
        if x != x or abs(x) >= 2**52 or x != int(x):
            return None
        x = int(x)
    elif op == "=" and not abs(x) >= 2:  # nearer to 0, other values count as equal too
        return None
    else:
        x = float(x)
    y = F.lit(x)
    c = a.col if a.type == "int" else a.col.cast("double")
    test = {"=": c == y, "<": c < y, "<=": c <= y, ">": c > y, ">=": c >= y}[op]
    zero = {"=": x == 0, "<": 0 < x, "<=": 0 <= x, ">": 0 > x, ">=": 0 >= x}[op]
    return a.col.isNull() | test if zero else a.col.isNotNull() & test


_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def equal(a: Value, b: Value) -> Column:
    """Never missing."""
    nested(a), nested(b)
    if a.type in NUMERIC and b.type in NUMERIC:
        plain = _against("=", a, b)
        if plain is None:
            plain = _against("=", b, a)
        if plain is not None:
            return plain
        if a.type == b.type == "int":
            return F.coalesce(a.col, F.lit(0)) == F.coalesce(b.col, F.lit(0))
        x, y = number0(a), number0(b)
        return (x == y) | F.coalesce(F.abs(x - y) < EPSILON, F.lit(False))
    if a.type == "null" or b.type == "null":
        return (b if a.type == "null" else a).col.isNull()
    if a.type == b.type or {a.type, b.type} == {"date", "ts"}:
        return a.col.eqNullSafe(b.col)
    return a.col.isNull() & b.col.isNull()


def compare(op: str, a: Value, b: Value) -> Column:
    """Never missing."""
    nested(a), nested(b)
    if a.type not in NUMERIC and (a.type == b.type or {a.type, b.type} <= {"date", "ts"}):
        x, y = a.col, b.col
    elif {"date", "ts", "time"} & {a.type, b.type}:
        if "null" not in (a.type, b.type):
            raise refuse("dates compare with dates only, times with times")
        return F.lit(False)
    else:
        plain = _against(op, a, b)
        if plain is None:
            plain = _against(_TURNED[op], b, a)
        if plain is not None:
            return plain
        x, y = number0(a), number0(b)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    known = [v.col.isNotNull() for v in (a, b) if not v.is_literal and v.type not in NUMERIC]
    return reduce(lambda p, q: p & q, [*known, out])


def divide(x: Column, y: Column) -> Column:
    by_zero = F.when(x > 0, INF).when(x < 0, -INF).otherwise(NAN)
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def modulo(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, NAN).otherwise(F.try_mod(x, y))


def half_away(q: Column) -> Column:
    """The nearest whole number, halves away from zero; the fraction itself is compared, as adding a half may round."""
    a = F.abs(q)
    low = F.floor(a).cast("double")
    return F.when(a < 2.0**52, F.signum(q) * (low + F.when(a - low >= 0.5, 1.0).otherwise(0.0))).otherwise(q)


def _to_scale(x: str, scale: str) -> str:
    """SQL text: the size of ``x`` as the nearest multiple of 1 / ``scale``; adding the double below a half rounds rightly where a half doesn't."""
    return f"floor(abs({x}) * {scale} + 0.49999999999999994D) / {scale}"


def snap_scale(x: str) -> str:
    """SQL text: the least power of ten on whose scale the double ``x`` has a rounding within 1e-12 of it, relative above 1.

    Twelve places always do; whole numbers from 2^52 on have none, as they stay as they are.
    """
    tests = [f"WHEN abs({_to_scale(x, s)} - abs({x})) <= 1.0E-12D * greatest(1.0D, abs({x})) THEN {s}" for s in (f"{10**p}.0D" for p in range(12))]
    return f"CASE WHEN abs({x}) >= {2**52}.0D THEN NULL {' '.join(tests)} ELSE {10**12}.0D END"


def snapped(x: str, scale: str) -> str:
    """SQL text: the double ``x`` as the rounding of that scale, halves away from zero; -0.0 becomes 0.0."""
    return f"coalesce(signum({x}) * ({_to_scale(x, scale)}), {x}) + 0.0D"


def snap_frame(frame: DataFrame, names: list[str], others: list[Column]) -> DataFrame:
    """The columns ``names``, doubles among them snapped, and ``others``.

    Written as SQL, so that it takes a call or two to the driver's JVM a column and not hundreds; scales are columns, as they are used twice.
    """

    def quoted(n: str) -> str:
        return "`" + n.replace("`", "``") + "`"

    doubles = {n: f"__s{i}" for i, n in enumerate(names) if isinstance(frame.schema[n].dataType, T.DoubleType)}
    scaled = frame.select(*[F.col(quoted(n)) for n in names], *others, *[F.expr(snap_scale(quoted(n))).alias(s) for n, s in doubles.items()])
    picked = [F.expr(snapped(quoted(n), doubles[n])).alias(n, metadata=frame.schema[n].metadata or {}) if n in doubles else F.col(quoted(n)) for n in names]
    return scaled.select(*picked, *[F.col(quoted(n)) for n in scaled.columns[len(names) : len(names) + len(others)]])


def snap(x: Column) -> Column:
    """As :func:`snap_frame`, of any column, but halves go to the even neighbour."""
    near = 1e-12 * F.greatest(F.lit(1.0), F.abs(x))
    out = None
    for p in range(14):
        scale = float(10**p)
        rounded = F.rint(x * scale) / scale
        test = F.abs(rounded - x) <= near
        out = F.when(test, rounded) if out is None else out.when(test, rounded)
    return out.otherwise(x) + F.lit(0.0)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def strip_right(s: Column) -> Column:
    return F.regexp_replace(s, f"[{_SPACE}]+$", "")


def remove_space(s: Column) -> Column:
    return F.regexp_replace(s, f"[{_SPACE}]+", "")
