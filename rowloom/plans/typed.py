"""Expressions to typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import formats, scalars
from ..functions import values as V
from ..functions.values import Value, lit, refuse
from .ast import Binary, Call, Index, Literal, Name, Unary


class NeedsRowLoop(Exception):
    """The step has state that no window expresses; rows must be visited in order."""


class Scope:
    """What names mean at one point of a step."""

    def __init__(self, variables: dict[str, Value], arrays: dict[str, list[str]], catalog: formats.Catalog, offset: Callable | None = None, functions: dict | None = None, probe: Callable | None = None):
        self.variables, self.arrays, self.catalog, self.offset, self.functions = variables, arrays, catalog, offset, functions or {}
        self.probe = probe  # gives the values of some columns in a few rows

    def value(self, name: str) -> Value:
        return self.variables.get(name.upper(), lit(None))


def evaluate(e, scope: Scope) -> Value:
    if isinstance(e, Literal):
        return lit(e.value)
    if isinstance(e, Name):
        return scope.value(e.name)
    if isinstance(e, Index):
        return element(e.array, evaluate(e.at, scope), scope)
    if isinstance(e, Unary):
        v = evaluate(e.arg, scope)
        return Value(~V.boolean(v), "bool", sure=True) if e.op == "not" else Value(-V.number(v), "num")
    if isinstance(e, Binary):
        return binary(e.op, evaluate(e.left, scope), evaluate(e.right, scope))
    assert isinstance(e, Call)
    name = e.name
    if name in scope.arrays_low():
        return element(scope.arrays_low()[name], evaluate(e.args[0], scope), scope)
    if name == "dim":
        return lit(float(len(members(e.args[0], scope))))
    if name == "vname":
        if not isinstance(e.args[0], (Index, Call)):
            return lit(getattr(e.args[0], "name", None))
        array = e.args[0].array if isinstance(e.args[0], Index) else scope.arrays_low().get(e.args[0].name, e.args[0].name)
        at = e.args[0].at if isinstance(e.args[0], Index) else e.args[0].args[0]
        place = V.number(evaluate(at, scope)).cast("int")
        return Value(F.element_at(F.array(*[F.lit(m) for m in scope.arrays[array]]), place), "str")
    if name in ("lag", "lead", "shift"):
        if scope.offset is None:
            raise refuse(f"{name} can't be used here")
        return scope.offset(e)
    if name == "put":
        return formats.put(evaluate(e.args[0], scope), e.format or "", scope.catalog)
    if name == "input":
        return formats.read(evaluate(e.args[0], scope), e.format or "", scope.catalog)
    if name == "hour":
        return formats.hour(evaluate(e.args[0], scope))
    if name == "apply":
        return applied(e, scope)
    return scalars.call(name, [evaluate(a, scope) for a in e.args])


def _arrays_low(self: Scope) -> dict[str, str]:
    return {k.lower(): k for k in self.arrays}


Scope.arrays_low = _arrays_low


def members(e, scope: Scope) -> list[str]:
    name = getattr(e, "name", "")
    if name not in scope.arrays:
        raise refuse(f"unknown array: {name}")
    return scope.arrays[name]


def element(array: str, at: Value, scope: Scope) -> Value:
    if array not in scope.arrays:
        raise refuse(f"unknown array: {array}")
    names = scope.arrays[array]
    if at.is_literal:
        i = int(at.literal) if isinstance(at.literal, (int, float)) else 0
        if not 1 <= i <= len(names):
            raise refuse(f"array index out of bounds: {array}[{i}]")
        return scope.value(names[i - 1])
    vs = [scope.value(n) for n in names]
    kind = "null"
    for v in vs:
        kind = V.join(kind, v.type)
    place = V.number(at).cast("int")
    out = F.when((place < 1) | (place > len(vs)) | place.isNull(), F.raise_error(F.lit(f"array index out of bounds: {array}")).cast(V.SPARK_TYPE.get(kind, "void")))
    for i, v in enumerate(vs):
        out = out.when(place == i + 1, V.cast(v, kind))
    return Value(out, kind)


def binary(op: str, a: Value, b: Value) -> Value:
    if op == "||":
        return Value(F.concat(V.text(a), V.text(b)), "str")
    if op in ("and", "or"):
        x, y = V.boolean(a), V.boolean(b)
        return Value(x & y if op == "and" else x | y, "bool", sure=True)
    if op in ("=", "^="):
        same = V.equal(a, b)
        return Value(same if op == "=" else ~same, "bool", sure=True)
    if op in ("<", "<=", ">", ">="):
        return Value(V.compare(op, a, b), "bool", sure=True)
    if op == "+" and a.type == b.type == "str":
        return Value(F.concat(a.col, b.col), "str")
    x, y = V.number(a), V.number(b)
    if op == "/":
        return Value(V.divide(x, y), "num")
    if op == "mod":
        return Value(V.modulo(x, y), "num")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "**": lambda: F.pow(x, y)}[op](), "num")


def applied(e: Call, scope: Scope) -> Value:
    """A Python function on Arrow batches: its return type comes with it, or from its annotation, else it is a number."""
    import builtins

    from pyspark.sql.pandas.functions import pandas_udf

    if not e.args or not isinstance(e.args[0], Literal) or not isinstance(e.args[0].value, str):
        raise V.StepError("RUNTIME_APPLY_TARGET_INVALID", "apply needs the function's name as a string", "execute")
    name = e.args[0].value
    safe = {"abs", "all", "any", "bool", "float", "int", "len", "max", "min", "round", "str", "sum"}
    target = getattr(builtins, name) if name in safe else scope.functions.get(name)
    if target is None and "." in name and "__" not in name:
        import importlib

        module, _, attribute = name.rpartition(".")
        try:
            target = getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError):
            target = None
    kind, vector = None, False
    if isinstance(target, tuple):  # callable and type, and whether it takes and gives whole pandas series
        target, kind, vector = (*target, False)[:3]
    if not callable(target):
        raise V.StepError("RUNTIME_APPLY_TARGET_UNRESOLVED", f"no function {name}", "execute")
    if kind is None:
        hint = {"abs": float, "str": str, "bool": bool, "all": bool, "any": bool}.get(name) or getattr(target, "__annotations__", {}).get("return")
        kind = {str: "string", bool: "boolean", "str": "string", "bool": "boolean"}.get(hint, None if hint is None else "double")
    args = [evaluate(a, scope) for a in e.args[1:]]
    if kind is None:
        kind = _probed(target, args, scope)
    out = {"string": "str", "boolean": "bool"}.get(kind, "num")
    import pandas as pd

    def run(*series):
        if vector:
            return pd.Series(target(*series))
        rows = zip(*[[None if pd.isna(x) else x for x in s] for s in series], strict=True)
        back = [target(*r) for r in rows]
        return pd.Series([None if x is None else {"str": str, "bool": bool, "num": float}[out](x) for x in back], dtype="object")

    def single(series):
        return run(series)

    def packed(frame):
        return run(*[frame[c] for c in frame.columns])

    single.__annotations__ = {"series": pd.Series, "return": pd.Series}  # real types: strings are not read
    packed.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}

    columns = [a.col.cast("double") if a.type in ("num", "null") else a.col for a in args]
    if len(columns) == 1:
        return Value(pandas_udf(single, kind)(columns[0]), out)
    return Value(pandas_udf(packed, kind)(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(columns)])), out)


def _probed(target, args: list[Value], scope: Scope) -> str:
    """The type of what an unannotated function gives for the first rows that it can be called with; a number where it gives nothing."""
    for row in scope.probe(args) if scope.probe is not None and args else ():
        try:
            got = target(*row)
        except Exception:  # the function's own fault with this row, which shows again when the step is read
            continue
        if got is not None:
            return "string" if isinstance(got, str) else "boolean" if isinstance(got, bool) else "double"
    return "double"


def where_option(e, columns: dict[str, Value]):
    """The predicate of ``where=``: three-valued, as an ordinary filter."""
    if isinstance(e, Unary):
        if e.op == "isnull":
            return _column(e.arg, columns).col.isNull()
        return ~where_option(e.arg, columns)
    if e.op in ("and", "or"):
        a, b = where_option(e.left, columns), where_option(e.right, columns)
        return a & b if e.op == "and" else a | b
    a, b = (_column(x, columns) if isinstance(x, Name) else lit(x.value) for x in (e.left, e.right))
    if a.type in ("date", "ts") and b.is_literal:
        b = Value(b.col.cast("timestamp"), "ts")
    x, y = a.col, b.col
    return {"=": x == y, "^=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op]


def _column(e, columns: dict[str, Value]) -> Value:
    v = columns.get(getattr(e, "name", "").upper())
    if v is None:
        raise V.StepError("VALIDATE_COLUMN_NOT_FOUND", f"no column {getattr(e, 'name', '?')}", "validate")
    return v
