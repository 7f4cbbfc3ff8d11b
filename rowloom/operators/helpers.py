"""Column-oriented helpers: projections, filters, sorting, casts, transposition and assignments."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import formats, scalars
from ..functions import values as V
from ..functions.values import Value, lit, type_of
from ..plans.ast import Binary, Call, Literal, Name, Unary
from ..plans.parser import Expressions, parse_expression
from ..sources.catalog import Dataset
from .inputs import apply_options, ascending, quoted, resolve

# Type names of ``cast``; unsigned ones widen and are range-checked.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bool": "boolean", "str": "string", "string": "string", "utf8": "string",
}
_UNSIGNED = {"uint8": 2**8, "uint16": 2**16, "uint32": 2**32, "uint64": 2**64}


def pick(data: Dataset, name: str) -> str:
    found = resolve(name, data.columns)
    if found is None:
        raise KeyError(name)
    return found


def _listed(x) -> list[str]:
    return x.split() if isinstance(x, str) else list(x)


def select(data: Dataset, columns) -> Dataset:
    return data.with_(frame=data.frame.select(*[quoted(pick(data, c)) for c in _listed(columns)], *data.order))


def drop(data: Dataset, columns) -> Dataset:
    gone = {pick(data, c) for c in _listed(columns)}
    return select(data, [c for c in data.columns if c not in gone])


def rename(data: Dataset, mapping: dict[str, str]) -> Dataset:
    new = {pick(data, a): b for a, b in mapping.items()}
    names = [new.get(c, c) for c in data.columns]
    if len({n.upper() for n in names}) < len(names):
        raise ValueError("two columns would have one name")
    return data.with_(frame=data.frame.withColumnsRenamed(new))


def where(data: Dataset, condition: str) -> Dataset:
    """One comparison of a column with a literal; rows where it is unknown go."""
    e = parse_expression(condition)
    if not (isinstance(e, Binary) and e.op in ("=", "^=", "<", "<=", ">", ">=") and isinstance(e.left, Name) and isinstance(e.right, Literal)):
        raise ValueError(f"a filter is one comparison of a column with a literal: {condition}")
    col, value = quoted(pick(data, e.left.name)), F.lit(e.right.value)
    test = {"=": col == value, "^=": col != value, "<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[e.op]
    return data.with_(frame=data.frame.where(test))


def options(data: Dataset, keep=None, drop=None, where=None, rename=None) -> Dataset:
    given: dict = {}
    if keep is not None:
        given["keep"] = _listed(keep)
    if drop is not None:
        given["drop"] = _listed(drop)
    if where is not None:
        given["where"] = Expressions(where, where_option=True).whole()
    if rename is not None:
        given["rename"] = dict(rename)
    return apply_options(data, given)


def _directions(data: Dataset, by) -> list[tuple[str, bool]]:
    parts = [by] if isinstance(by, (str, tuple)) else list(by)
    out = []
    for p in parts:
        name, way = (p, "ascending") if isinstance(p, str) else p
        way = way.strip().lower()
        if way not in ("ascending", "descending", "asc", "desc"):
            raise ValueError(f"unknown direction: {way}")
        out.append((pick(data, name), way.startswith("asc")))
    return out


def sort(data: Dataset, by, nodupkey: bool = False) -> Dataset:
    """Stable, missing values last either way. The order is kept as hidden keys, so the sort itself is put off to the reader."""
    keys = _directions(data, by)
    frame = data.frame
    if nodupkey:
        first = Window.partitionBy(*[quoted(c) for c, _ in keys]).orderBy(*ascending(list(data.order)))
        frame = frame.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    order, columns = [], []
    for i, (c, up) in enumerate(keys):
        if up:
            columns.append(quoted(c).alias(f"__n{i}"))
        else:  # hidden keys all ascend: missing last, then the rank from the top
            columns.append(_descending(frame, c).alias(f"__n{i}"))
        order.append(f"__n{i}")
    columns += [F.col(o).alias(f"__n{len(keys) + i}") for i, o in enumerate(data.order)]
    order += [f"__n{len(keys) + i}" for i in range(len(data.order))]
    frame = frame.select(*[quoted(c) for c in data.columns], *columns)
    frame = frame.select(*[quoted(c) for c in data.columns], *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    return data.with_(frame=frame, order=tuple(f"__o{i}" for i in range(len(order))))


def _descending(frame, column: str) -> Column:
    """A key whose ascending order is the column's descending one."""
    kind, c = frame.schema[column].dataType.typeName(), quoted(column)
    if kind.startswith("time") and not kind.startswith("timestamp"):
        kind, c = "string", c.cast("string")
    if kind in ("string", "binary"):  # complement of the bytes, closed by a byte above all of them
        return F.when(c.isNotNull(), F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    if kind == "boolean":
        return ~c
    if kind == "date":
        return -F.unix_date(c)
    if kind.startswith("timestamp"):
        return -F.unix_micros(c.cast("timestamp"))
    if kind in ("byte", "short", "integer", "long"):
        return F.bitwise_not(c)
    return -c


def cast(data: Dataset, kinds: dict[str, str]) -> Dataset:
    changes = {}
    for name, kind in kinds.items():
        key = str(kind).strip().lower()
        if key not in TYPES:
            raise ValueError(f"unknown type: {kind}")
        column = pick(data, name)
        new = quoted(column).cast(TYPES[key])
        if key in _UNSIGNED:
            bad = (new < 0) | (new >= F.lit(_UNSIGNED[key]).cast("decimal(20,0)" if key != "uint64" else "decimal(21,0)"))
            new = F.when(bad, F.raise_error(F.lit(f"{column} is out of range for {key}")).cast(TYPES[key])).otherwise(new)
        changes[column] = new
    return data.with_(frame=data.frame.withColumns(changes))


MOST_COLUMNS = 10_000


def _bounded(columns: int) -> None:
    if columns > MOST_COLUMNS:
        raise ValueError(f"transpose would make more than {MOST_COLUMNS} columns")


def transpose(data: Dataset, by, var, id=None) -> Dataset:  # noqa: A002
    """Groups in first-seen order. Without ``id``: a row a variable, its values in COL1, COL2 and so on. With ``id``: a row a group, a column an id."""
    keys, variables = [pick(data, c) for c in _listed(by)], [pick(data, c) for c in _listed(var)]
    frame, order = data.frame, list(data.order)
    group = [quoted(k) for k in keys]
    seen = F.min(F.struct(*[F.col(o) for o in order])).alias("__seen")
    if id is None:
        ranked = frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*ascending(order))))
        widest = ranked.agg(F.max("__rn")).first()[0] or 0  # the number of columns: one value
        _bounded(widest)
        unit = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("name"), quoted(v).alias("value")) for i, v in enumerate(variables)])).alias("__u")
        long = ranked.select(*group, F.struct(*[F.col(o) for o in order]).alias("__at"), "__rn", unit)
        values = [F.max(F.when(F.col("__rn") == i + 1, F.struct(F.col("__u.value").alias("v"))))["v"].alias(f"COL{i + 1}") for i in range(widest)]
        wide = long.groupBy(*group, F.col("__u.i").alias("__o1"), F.col("__u.name").alias("_NAME_")).agg(F.min("__at").alias("__s"), *values)
        first = Window.partitionBy(*group)
        wide = wide.withColumn("__o0", F.min("__s").over(first)).select(*group, "_NAME_", *[f"COL{i + 1}" for i in range(widest)], "__o0", "__o1")
        return data.with_(frame=wide, order=("__o0", "__o1"))
    ids = _listed(id)
    if len(ids) != 1 or len(variables) != 1:
        raise ValueError("transpose with id takes one id and one variable")
    name, value = quoted(pick(data, ids[0])), quoted(variables[0])
    bad = frame.groupBy(*group, name.alias("__id")).count().where((F.col("count") > 1) | F.col("__id").isNull() | (F.col("__id").cast("string") == "")).limit(1).collect()
    if bad:
        raise ValueError("an id is missing or repeated in a group")
    found = frame.groupBy(name.cast("string").alias("id")).agg(seen).limit(MOST_COLUMNS + 1).collect()  # one value a new column
    _bounded(len(found))
    columns = [r["id"] for r in sorted(found, key=lambda r: tuple(r["__seen"]))]
    cells = [F.max(F.when(name.cast("string") == c, F.struct(value.alias("v"))))["v"].alias(c) for c in columns]
    return data.with_(frame=frame.groupBy(*group).agg(*cells, seen.alias("__o0")), order=("__o0",))


# ---- assign: three-valued logic, text functions see '' for missing

ASSIGN = frozenset("upcase lowcase propcase cat cats catt catx index find tranwrd translate length lengthn strip substr scan compress trim reverse repeat countw round put input hour".split())


def assign(data: Dataset, catalog: formats.Catalog, **expressions) -> Dataset:
    frame = data.frame
    for name, written in expressions.items():
        columns = [c for c in frame.columns if not c.startswith("__")]
        types = {c.upper(): Value(quoted(c), type_of(frame.schema[c].dataType)) for c in columns}
        v = assigned(written, types, catalog) if isinstance(written, str) else lit(written)
        target = resolve(name, columns) or name
        frame = frame.withColumn(target, v.col)
    hidden = [c for c in frame.columns if c.startswith("__")]
    return data.with_(frame=frame.select(*[quoted(c) for c in frame.columns if not c.startswith("__")], *hidden))


def assigned(written: str, types: dict[str, Value], catalog: formats.Catalog) -> Value:
    m = re.fullmatch(r"\s*case\s(.+?)\send\s*", written, re.I | re.S)
    if not m:
        return plain(parse_expression(written), types, catalog)
    parts = re.split(r"\b(when|then|else)\b(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", m[1], flags=re.I)
    words = [(parts[i].lower(), parts[i + 1]) for i in range(1, len(parts) - 1, 2)]
    arms: list[tuple[Column, Value]] = []
    otherwise = lit(None)
    for (a, x), (_, y) in zip(words, [*words[1:], ("", "")], strict=True):
        if a == "when":
            arms.append((plain(parse_expression(x), types, catalog).col, plain(parse_expression(y), types, catalog)))
        elif a == "else":
            otherwise = plain(parse_expression(x), types, catalog)
    kind = otherwise.type
    for _, v in arms:
        kind = V.join(kind, v.type)
    out = F.when(arms[0][0], V.cast(arms[0][1], kind))
    for test, v in arms[1:]:
        out = out.when(test, V.cast(v, kind))
    return Value(out.otherwise(V.cast(otherwise, kind)), kind)


def plain(e, types: dict[str, Value], catalog: formats.Catalog) -> Value:
    if isinstance(e, Literal):
        return lit(e.value)
    if isinstance(e, Name):
        if e.name.upper() not in types:
            raise KeyError(e.name)
        return types[e.name.upper()]
    if isinstance(e, Unary):
        v = plain(e.arg, types, catalog)
        return Value(~v.col, "bool") if e.op == "not" else Value(-v.col, v.type)
    if isinstance(e, Binary):
        a, b = plain(e.left, types, catalog), plain(e.right, types, catalog)
        if e.op == "||":
            return Value(F.concat(V.text(a), V.text(b)), "str")
        if e.op in ("and", "or"):
            return Value(a.col & b.col if e.op == "and" else a.col | b.col, "bool")
        if e.op in ("=", "^=", "<", "<=", ">", ">="):
            x, y = a.col, b.col
            return Value({"=": x == y, "^=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op], "bool")
        if e.op == "+" and a.type == b.type == "str":
            return Value(F.concat(a.col, b.col), "str")
        whole = a.type == b.type == "int"
        if e.op in ("+", "-", "*") and whole:
            x, y = a.col, b.col
            return Value(x + y if e.op == "+" else x - y if e.op == "-" else x * y, "int")
        x, y = V.number(a), V.number(b)
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: V.divide(x, y), "mod": lambda: V.modulo(x, y), "**": lambda: F.pow(x, y)}[e.op]()
        return Value(out, "num")
    assert isinstance(e, Call)
    if e.name not in ASSIGN:
        raise ValueError(f"assign has no function {e.name}")
    args = [plain(a, types, catalog) for a in e.args]
    if e.name == "put":
        return formats.put(args[0], e.format or "", catalog)
    if e.name == "input":
        return formats.read(args[0], e.format or "", catalog)
    if e.name == "hour":
        return formats.hour(args[0])
    if e.name == "trim":
        return Value(V.strip_right(V.text(args[0])), "str")
    if e.name in ("length", "lengthn"):
        return Value(F.char_length(V.text(args[0])).cast("long"), "int")
    if e.name == "round":
        unit = args[1].literal if len(args) > 1 else 1
        places = max(0, -int(f"{float(unit):e}".split("e")[1])) if unit else 0
        out = scalars.rounded(*args).col
        return Value(F.when(V.number(args[0]).isNull(), None).otherwise(V.snap(F.round(out, places))), "num")
    return scalars.call(e.name, args)
