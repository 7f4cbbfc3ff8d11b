"""What a step reads: dataset options, SET (concatenated or interleaved) and MERGE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..diagnostics import StepError
from ..functions.values import Value, type_of
from ..plans.ast import DatasetRef, Statement
from ..plans.typed import where_option
from ..sources.catalog import Catalog, Dataset
from . import whole_order


@dataclass
class Prepared:
    """Rows of a step before its WHERE: visible columns, hidden order, and hidden variables by name."""

    frame: DataFrame
    columns: list[str]
    order: list[str]
    hidden: dict[str, str] = field(default_factory=dict)  # variable (upper case) -> column
    by: list[str] = field(default_factory=list)
    repeats: Callable[[], DataFrame] | None = None  # of a merge: BY values that are repeated in several sources


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve(name: str, columns: list[str]) -> str | None:
    if name in columns:
        return name
    hits = [c for c in columns if c.upper() == name.upper()]
    return hits[0] if len(hits) == 1 else None


def need(name: str, columns: list[str], code: str = "VALIDATE_COLUMN_NOT_FOUND", text: str = "") -> str:
    found = resolve(name, columns)
    if found is None:
        raise StepError(code, f"no column {name}", "validate", text)
    return found


def ascending(columns: list[str]) -> list[Column]:
    return [quoted(c).asc_nulls_last() for c in columns]


def apply_options(data: Dataset, options: dict, text: str = "") -> Dataset:
    """keep, drop, where, rename, then firstobs and obs (a row count)."""
    frame, order = data.frame, list(data.order)
    columns = data.columns
    if "keep" in options:
        kept = {need(c, columns, text=text) for c in options["keep"]}
        columns = [c for c in columns if c in kept]
    if "drop" in options:
        gone = {need(c, columns, text=text) for c in options["drop"]}
        columns = [c for c in columns if c not in gone]
    if "where" in options:
        types = {c.upper(): Value(quoted(c), type_of(frame.schema[c].dataType)) for c in columns}
        frame = frame.where(where_option(options["where"], types))
    names = {c: c for c in columns}
    for old, new in options.get("rename", {}).items():
        found = resolve(old, columns)
        if found is None:
            raise StepError("RUNTIME_DATASET_OPTION_INVALID", f"rename=: no column {old}", "pre-processing inputs", text)
        names[found] = new
    if len({n.upper() for n in names.values()}) < len(names):
        raise StepError("RUNTIME_DATASET_OPTION_INVALID", "rename=: two columns get one name", "pre-processing inputs", text)
    frame = frame.select(*[quoted(c).alias(n) for c, n in names.items()], *order)
    first, count = options.get("firstobs", 1), options.get("obs")
    if first < 1 or (count is not None and count < 0):
        raise StepError("RUNTIME_DATASET_OPTION_INVALID", "firstobs= must be positive and obs= not negative", "pre-processing inputs", text)
    if first > 1 or count is not None:
        frame = slice_rows(frame, order, first, count)
    return data.with_(frame=frame)


def slice_rows(frame: DataFrame, order: list[str], first: int, count: int | None) -> DataFrame:
    """Rows ``first`` (from 1) on in the given order. Top-k selection, so that no task sorts all rows, where there is a count."""
    sort = ascending(order)
    if count is not None:
        frame = frame.orderBy(*sort).limit(first - 1 + count)
    if first == 1:
        return frame
    return whole_order.number(frame, order, "__rn").where(F.col("__rn") >= first).drop("__rn")


def read_inputs(statement: Statement, catalog: Catalog, by: list[str], generated: dict[str, Dataset]) -> Prepared:
    sources: list[tuple[DatasetRef, Dataset]] = []
    for ref in statement.data["refs"]:
        if ref.name in generated_keys(generated, ref.name):
            data = generated[generated_keys(generated, ref.name)[ref.name]]
        elif ref.name in catalog:
            data = catalog[ref.name]
        else:
            raise StepError("RUNTIME_SET_DATASET_NOT_FOUND", f"no dataset {ref.name}", "validate", statement.text)
        sources.append((ref, apply_options(data, ref.options, statement.text)))
    _collisions(statement, sources, by)
    for _, d in sources:
        for k in by:
            found = resolve(k, d.columns)
            if found is not None and type_of(d.frame.schema[found].dataType) == "other":
                raise StepError("RUNTIME_BY_PRECONDITION_FAILED", f"{k} is nested and can't order rows", "pre-evaluations", statement.text)
    if statement.kind == "set":
        out = concatenate(statement, sources, by)
    else:
        out = merge_by(statement, sources, by) if by else merge_by_place(statement, sources)
    return flags(out, statement)


def generated_keys(generated: dict[str, Dataset], name: str) -> dict[str, str]:
    from ..sources.catalog import key_of

    return {name: key_of(name)} if key_of(name) in generated else {}


def _collisions(statement: Statement, sources, by: list[str]) -> None:
    taken = {c.upper() for _, d in sources for c in d.columns}
    names = [r.options["in"] for r, _ in sources if "in" in r.options] + [statement.data[k] for k in ("end", "indsname") if k in statement.data]
    names += [f"{p}.{k}" for k in by for p in ("first", "last")]
    for n in names:
        if n.upper() in taken:
            raise StepError("RUNTIME_INTERNAL_VAR_NAME_COLLISION", f"{n} is a column already", "pre-evaluations", statement.text)


def _same_type(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, T.NullType) or isinstance(b, T.NullType) or type(a) is type(b) is T.StringType


def concatenate(statement: Statement, sources, by: list[str]) -> Prepared:
    columns: dict[str, tuple[str, T.DataType]] = {}
    for _, d in sources:
        for c in d.columns:
            kind = d.frame.schema[c].dataType
            known = columns.get(c.upper())
            if known is None or isinstance(known[1], T.NullType):
                columns[c.upper()] = (known[0] if known else c, kind)
            elif not _same_type(known[1], kind):
                raise StepError("RUNTIME_SET_SCHEMA_INCOMPATIBLE", f"{c} has different types", "pre-processing inputs", statement.text)
    width = max(len(d.order) for _, d in sources)
    single = len(sources) == 1
    # Sources may be ordered by keys of different types; only equal shapes are compared, else the rows' own numbers.
    shapes = {tuple(d.frame.schema[o].dataType.simpleString() for o in d.order) for _, d in sources}
    if len(shapes) > 1:
        sources = [(r, renumber(d)) for r, d in sources]
        width = 1
    frames, hidden = [], {}
    for i, (ref, d) in enumerate(sources):
        own = {c.upper(): c for c in d.columns}
        picked = []
        for k, (name, kind) in columns.items():
            source = quoted(own[k]) if k in own else F.lit(None)
            meta = d.frame.schema[own[k]].metadata if k in own else None
            picked.append((source.cast(kind) if k not in own or d.frame.schema[own[k]].dataType != kind else source).alias(name, metadata=meta or {}))
        picked += [] if single else [F.lit(i).alias("__src")]
        picked += [F.col(o).alias(f"__i{j}") for j, o in enumerate(d.order)]
        for j, (other, _) in enumerate(sources):
            if "in" in other.options:
                hidden[other.options["in"].upper()] = f"__in{j}"
                picked.append(F.lit(int(i == j)).alias(f"__in{j}"))
        if "indsname" in statement.data:
            hidden[statement.data["indsname"].upper()] = "__dsname"
            picked.append(F.lit(ref.name).alias("__dsname"))
        frames.append(d.frame.select(*picked))
    frame = reduce(lambda a, b: a.unionByName(b), frames)
    names = [n for n, _ in columns.values()]
    keys = [need(k, names, "RUNTIME_BY_PRECONDITION_FAILED", statement.text) for k in by]
    order = keys + ([] if single else ["__src"]) + [f"__i{j}" for j in range(width)]
    return Prepared(frame, names, order, hidden, keys)


def renumber(data: Dataset) -> Dataset:
    """The same rows with one number for their order."""
    frame = whole_order.number(data.frame, list(data.order), "__n")
    return data.with_(frame=frame.drop(*data.order).withColumnRenamed("__n", "__o0"), order=("__o0",))


def merge_by(statement: Statement, sources, by: list[str]) -> Prepared:
    """Occurrence-aligned full outer merge: a key has as many rows as its largest group, shorter groups repeat their last row."""
    keys = [need(k, d.columns, "RUNTIME_BY_PRECONDITION_FAILED", statement.text) and k for k in by for _, d in sources[:1]]
    for _, d in sources:
        for k in by:
            need(k, d.columns, "RUNTIME_BY_PRECONDITION_FAILED", statement.text)
    first = sources[0][1]
    keys = [resolve(k, first.columns) or k for k in by]
    seen: dict[str, str] = {}
    for _, d in sources:
        for k in keys:
            a, b = first.frame.schema[resolve(k, first.columns) or k].dataType, d.frame.schema[resolve(k, d.columns) or k].dataType
            if not _same_type(a, b):
                raise StepError("RUNTIME_BY_PRECONDITION_FAILED", f"{k} has different types", "pre-evaluations", statement.text)
        for c in d.columns:
            if c.upper() not in {k.upper() for k in by}:
                if c.upper() in seen:
                    raise StepError("RUNTIME_MERGE_DUPLICATE_COLUMN", f"{c} is in two sources", "pre-evaluations", statement.text)
                seen[c.upper()] = c
    repeats = lambda: repeated_by_values([d.frame.select(*[quoted(resolve(k, d.columns)).alias(k) for k in keys]) for _, d in sources], keys)
    one = unique_side([d for _, d in sources], keys) if len(sources) == 2 else None
    if one is not None:
        return merge_to_unique(sources, keys, one, repeats)
    n = len(keys)
    parts, hidden, names = [], {}, list(keys)
    for i, (ref, d) in enumerate(sources):
        own = [resolve(k, d.columns) for k in keys]
        rest = [c for c in d.columns if c not in own]
        names += rest
        group = Window.partitionBy(*[quoted(k) for k in own])
        ranked = d.frame.select(
            *[quoted(k).alias(f"__k{i}_{j}") for j, k in enumerate(own)],
            *[quoted(c) for c in rest],
            F.row_number().over(group.orderBy(*ascending(list(d.order)))).alias(f"__rn{i}"),
            F.count(F.lit(1)).over(group).alias(f"__cnt{i}"),
        )
        parts.append(ranked)
        if "in" in ref.options:
            hidden[ref.options["in"].upper()] = f"__in{i}"
    sizes = [p.where(F.col(f"__rn{i}") == 1).select(*[F.col(f"__k{i}_{j}").alias(f"__k{j}") for j in range(n)], F.col(f"__cnt{i}").alias("__c")) for i, p in enumerate(parts)]
    slots = reduce(lambda a, b: a.union(b), sizes).groupBy(*[f"__k{j}" for j in range(n)]).agg(F.max("__c").alias("__m"))
    out = slots.withColumn("__slot", F.explode(F.sequence(F.lit(1), F.col("__m").cast("int"))))
    for i, (p, size) in enumerate(zip(parts, sizes, strict=True)):
        # The group's size comes first, so that both joins are equi-joins and large groups are split like any skewed key.
        size = size.select(*[F.col(f"__k{j}").alias(f"__s{i}_{j}") for j in range(n)], F.col("__c").alias(f"__n{i}"))
        match = reduce(lambda a, b: a & b, [F.col(f"__k{j}").eqNullSafe(F.col(f"__s{i}_{j}")) for j in range(n)])
        out = out.join(size, match, "left").withColumn(f"__at{i}", F.least(F.col("__slot"), F.col(f"__n{i}").cast("int"))).drop(*[f"__s{i}_{j}" for j in range(n)])
        match = reduce(lambda a, b: a & b, [F.col(f"__k{j}").eqNullSafe(F.col(f"__k{i}_{j}")) for j in range(n)]) & (F.col(f"__at{i}") == F.col(f"__rn{i}"))
        out = out.join(p, match, "left").withColumn(f"__in{i}", F.col(f"__n{i}").isNotNull().cast("int"))
    frame = out.select(*[F.col(f"__k{j}").alias(k) for j, k in enumerate(keys)], *[quoted(c) for c in names[n:]], *[f"__in{i}" for i in range(len(sources))], "__slot")
    return Prepared(frame, names, [*keys, "__slot"], hidden, keys, repeats)


def unique_side(sources: list[Dataset], keys: list[str]) -> int | None:
    """Which of two sources has no repeated key. One job over the smaller source's keys tells, and if that has, nothing more is asked."""
    small = min(range(2), key=lambda i: whole_order.source_bytes(sources[i].frame))
    d = sources[small]
    own = [quoted(resolve(k, d.columns)) for k in keys]
    return small if d.frame.groupBy(*own).count().where("count > 1").limit(1).isEmpty() else None


def merge_to_unique(sources, keys: list[str], one: int, repeats: Callable[[], DataFrame]) -> Prepared:
    """The merge of two sources where ``one`` has each key once: a plain outer join, in the other's order within a key.

    Filters on the IN= flags turn it into an inner, left or right join.
    """
    sides, names, hidden = [], list(keys), {}
    for i, (ref, d) in enumerate(sources):
        own = [resolve(k, d.columns) for k in keys]
        rest = [c for c in d.columns if c not in own]
        names += rest
        place = [quoted(c).alias(f"__m{j}") for j, c in enumerate(d.order)] if i != one else []
        sides.append(d.frame.select(*[quoted(k).alias(f"__k{i}_{j}") for j, k in enumerate(own)], *[quoted(c) for c in rest], F.lit(1).alias(f"__is{i}"), *place))
        if "in" in ref.options:
            hidden[ref.options["in"].upper()] = f"__in{i}"
    match = reduce(lambda a, b: a & b, [F.col(f"__k0_{j}").eqNullSafe(F.col(f"__k1_{j}")) for j in range(len(keys))])
    out = sides[0].join(sides[1], match, "full_outer")
    order = [f"__m{j}" for j in range(len(sources[1 - one][1].order))]
    flags_ = [F.coalesce(f"__is{i}", F.lit(0)).alias(f"__in{i}") for i in range(2)]
    frame = out.select(*[F.coalesce(f"__k0_{j}", f"__k1_{j}").alias(k) for j, k in enumerate(keys)], *[quoted(c) for c in names[len(keys) :]], *flags_, *order)
    return Prepared(frame, names, [*keys, *order], hidden, keys, repeats)


def repeated_by_values(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that are repeated in two sources or more (the warning about them costs a job, so it is made with ``check_outputs`` only)."""
    each = [s.groupBy(*keys).count().where("count > 1").select(*keys) for s in sources]
    return reduce(lambda a, b: a.union(b), each).groupBy(*keys).count().where("count > 1").select(*keys)


def merge_by_place(statement: Statement, sources) -> Prepared:
    """Row by row; a later source overwrites a common column where it has a row."""
    names: list[str] = []
    types: dict[str, T.DataType] = {}
    frame, hidden = None, {}
    for i, (ref, d) in enumerate(sources):
        for c in d.columns:
            kind = d.frame.schema[c].dataType
            if c.upper() in types and not _same_type(types[c.upper()], kind):
                raise StepError("RUNTIME_SET_SCHEMA_INCOMPATIBLE", f"{c} has different types", "pre-evaluations", statement.text)
            types.setdefault(c.upper(), kind)
        placed = whole_order.number(d.frame, list(d.order), "__p").select(*[quoted(c).alias(f"__m{i}_{c}") for c in d.columns], "__p", F.lit(1).alias(f"__in{i}"))
        frame = placed if frame is None else frame.join(placed, "__p", "full_outer")
        if "in" in ref.options:
            hidden[ref.options["in"].upper()] = f"__in{i}"
    picked: dict[str, tuple[str, Column]] = {}
    for i, (_, d) in enumerate(sources):
        for c in d.columns:
            mine = F.col(f"`__m{i}_{c}`")
            old = picked.get(c.upper())
            picked[c.upper()] = (old[0], F.when(F.col(f"__in{i}").isNotNull(), mine).otherwise(old[1])) if old else (c, mine)
    names = [n for n, _ in picked.values()]
    flags_ = [F.coalesce(F.col(f"__in{i}"), F.lit(0)).alias(f"__in{i}") for i in range(len(sources))]
    return Prepared(frame.select(*[c.alias(n) for n, c in picked.values()], "__p", *flags_), names, ["__p"], hidden, [])


def flags(p: Prepared, statement: Statement) -> Prepared:
    """END=, on the rows as prepared."""
    if "end" in statement.data:
        p.frame = whole_order.is_last(p.frame, p.order, "__end")
        p.hidden[statement.data["end"].upper()] = "__end"
    return p


def group_flags(p: Prepared, wanted: set[str]) -> Prepared:
    """FIRST. and LAST. of each key by itself: against the neighbouring row, whatever the other keys do.

    With one key the rows of a value are neighbours, so the window is partitioned by it; further keys need the whole order.
    """
    for i, k in enumerate(p.by):
        for side in ("FIRST", "LAST"):
            if f"{side}.{k.upper()}" not in wanted:
                continue
            at = [c for c in p.order if c != k]
            if i == 0:
                group = Window.partitionBy(quoted(k)).orderBy(*ascending(at))
                edge = F.row_number().over(group) == 1 if side == "FIRST" else F.lead(F.lit(1)).over(group).isNull()
            else:
                p.frame = whole_order.neighbours(p.frame, p.order, [("__there", "__near", quoted(k), -1 if side == "FIRST" else 1)])
                edge = ~F.col("__there") | ~quoted(k).eqNullSafe(F.col("__near"))
            p.frame = p.frame.withColumn(f"__{side.lower()}{i}", edge).drop("__there", "__near")
            p.hidden[f"{side}.{k.upper()}"] = f"__{side.lower()}{i}"
    return p
