"""The ordered row loop: for steps whose state no window expresses.

Prepared rows stream, sorted, through Arrow batches; memory holds one batch and the step's variables. A step whose state
is all reset under FIRST. of its first BY key needs the order within that key's groups only, so groups are dealt to all
tasks; any other state can depend on every earlier row, so its rows go through one task. Only columns the step reads go
in beside those it passes on. WHERE without state is applied before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..diagnostics import StepError
from ..functions import values as V
from ..functions.values import Value, lit
from ..operators import whole_order
from ..operators.inputs import ascending, quoted
from ..sources.catalog import Dataset, key_of
from .ast import Call, Literal, Name, expressions, in_statement, walk

_SPARK = {"int": T.LongType(), "num": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "date": T.DateType(), "ts": T.TimestampType(), "null": T.DoubleType()}


def infer(step) -> dict[str, str]:
    """Types of the step's variables, from its expressions with columns in place of values; repeated until nothing changes."""
    from .typed import Scope, evaluate

    kinds = {k: v.type for k, v in step.env.items()}
    for _ in range(10):
        env = {k: step.source.get(k) or Value(F.lit(None).cast(V.SPARK_TYPE.get(t, "double")) if t != "null" else F.lit(None), t) for k, t in kinds.items()}

        def offset(e: Call) -> Value:
            name = e.args[0].value if isinstance(e.args[0], Literal) else getattr(e.args[0], "name", None)
            default = lit(e.args[2].value) if len(e.args) > 2 and isinstance(e.args[2], Literal) else lit(None)
            inner = env.get(str(name).upper()) if name is not None else evaluate(e.args[0], scope)  # noqa: B023
            return Value(F.lit(None), V.join((inner or lit(None)).type, default.type))

        scope = Scope(env, step.arrays, step.formats, offset, step.functions)
        now = dict(kinds)

        def meet(name: str, kind: str) -> None:
            now[name.upper()] = V.join(now.get(name.upper(), "null"), kind)  # noqa: B023

        for s in walk(step.block.statements):
            if s.kind == "assign":
                kind = evaluate(s.data["expr"], scope).type
                for n in [s.data["var"]] if "var" in s.data else step.arrays[s.data["array"]]:
                    meet(n, kind)
            elif s.kind == "sum":
                now[s.data["var"].upper()] = "num"
            elif s.kind == "do":
                meet(s.data["var"], "int")
        for k, v in step.initial.items():
            if step.options.retain_initial:
                meet(k, lit(v).type)
        if now == kinds:
            return kinds
        kinds = now
    return kinds


def reset_by_group(step) -> bool:
    """Whether all state begins anew, by literals, with each group of the first BY key, before anything looks at it."""
    if not step.by or "_N_" in step.wanted or step.options.retain_initial:
        return False
    every = list(walk(step.block.statements))
    state = {s.data["var"].upper() for s in every if s.kind == "sum"} - set(step.source) | {n.upper() for n in step.retained}
    if state & set(step.source) or any(s.kind == "stop" for s in every):
        return False
    for s in every:
        for e in in_statement(s):
            if isinstance(e, Call) and e.name in ("lag", "lead", "shift") and (not e.args or step.offset_spec(e) is None):
                return False
    flag, left = f"FIRST.{step.by[0].upper()}", set(state)
    for s in step.block.statements:
        if s.kind == "if" and isinstance(s.data["cond"], Name) and s.data["cond"].name.upper() == flag and not s.orelse and all(x.kind == "assign" and "var" in x.data and isinstance(x.data["expr"], Literal) for x in s.body):
            left -= {x.data["var"].upper() for x in s.body}
            continue
        used = {e.name.upper() for x in walk([s]) for e in in_statement(x) if isinstance(e, Name)}
        used |= {x.data["var"].upper() for x in walk([s]) if x.kind in ("assign", "sum") and "var" in x.data}
        if used & left:
            return False
        if any(x.kind in ("subset", "delete") for x in walk([s])) and left:
            return False
    return not left and bool(state)


def run_loop(step) -> dict[str, Dataset]:
    from .compile import shape
    from .interpret import Program

    kinds = infer(step)
    called = {e.args[0].value for s in walk(step.block.statements) for e in in_statement(s) if isinstance(e, Call) and e.name == "apply" and e.args and isinstance(e.args[0], Literal)}
    frame = step.p.frame
    if "_N_" in step.wanted:
        frame = whole_order.number(frame, step.p.order, "__n").withColumn("__n", F.col("__n").cast("double"))
    stateless = step.where is not None and not any(isinstance(e, Call) and e.name in ("lag", "lead", "shift") for e in expressions(step.where.data["expr"])) and not ({e.name.upper() for e in expressions(step.where.data["expr"]) if isinstance(e, Name)} & set(step.names) - set(step.source))
    if stateless:
        frame = frame.where(V.boolean(step.eval(step.where.data["expr"])))
    lookahead = {}
    for s in walk(step.block.statements):
        for e in in_statement(s):
            if isinstance(e, Call) and e.name in ("lag", "lead", "shift") and e.args and (spec := step.offset_spec(e)):
                lookahead[spec[0].upper(), spec[1], spec[2].literal] = None
    source = list(step.p.columns)
    inner = {c: f"c{i}" for i, c in enumerate(source)}
    hidden = {n: c for n, c in step.p.hidden.items()}
    if "time" in {kinds.get(k) for k in step.names}:
        raise StepError("RUNTIME_EXPRESSION_EVALUATION_ERROR", "a row loop takes no time columns: drop them, or use put(t, time.) before", "execute")
    columns = [quoted(c).alias(inner[c]) for c in source] + [F.col(c).alias(f"h{i}") for i, c in enumerate(hidden.values())]
    columns += [F.col("__n").alias("n")] if "_N_" in step.wanted else []
    offsets = list(lookahead)
    step.frame = step.p.frame
    for i, (name, n, default) in enumerate(offsets):
        src = step.source.get(name)
        d = lit(default)
        if src is None:
            columns.append(d.col.cast("double").alias(f"l{i}") if d.type == "null" else d.col.alias(f"l{i}"))
            continue
        w = step_window(step)
        there = (F.lag(F.lit(1), -n) if n < 0 else F.lead(F.lit(1), n)).over(w)
        moved = (F.lag(src.col, -n) if n < 0 else F.lead(src.col, n)).over(w)
        kind = V.join(src.type, d.type)
        columns.append(F.when(there.isNotNull(), V.cast(Value(moved, src.type), kind)).otherwise(V.cast(d, kind)).alias(f"l{i}"))
    order = list(step.p.order)
    if stateless and offsets:
        raise StepError("RUNTIME_EXPRESSION_EVALUATION_ERROR", "positional lag and runtime state with where need separate steps", "execute")
    grouped = inner[step.by_column()] if reset_by_group(step) and (not step.where or stateless) else None
    dealt = frame.select(*columns, *[quoted(c).alias(f"s{i}") for i, c in enumerate(order)])
    dealt = dealt.repartition(grouped) if grouped else dealt.repartition(1)
    ordered = dealt.sortWithinPartitions(*[F.col(f"s{i}").asc_nulls_last() for i in range(len(order))])
    names = list(step.names.items())
    schema = T.StructType([T.StructField("t", T.StringType()), T.StructField("__o0", T.LongType())])
    places = [f"s{i}" for i in range(len(order))] if grouped else []  # groups lie in several tasks: rows are ordered as they came, then by number
    for c in places:
        schema = schema.add(f"__{c}", ordered.schema[c].dataType)
    for i, (k, _) in enumerate(names):
        kind = step.types[k] if k in step.types and kinds.get(k) == step.source[k].type else _SPARK[kinds.get(k, "null")]
        schema = schema.add(f"v{i}", kind)
    schema_json = schema.json()
    program = Program(step.block.statements, step.arrays, [k for k, _ in names], [n.upper() for n in step.retained], step.initial if step.options.retain_initial else {}, set(step.source), step.formats, {k: f for k, f in step.functions.items() if k in called}, step.explicit, step.default, list(step.refs), None if stateless or step.where is None else step.where.data["expr"], frame.sparkSession.conf.get("spark.sql.session.timeZone"))
    # The variables that a task's columns are, in their order: source columns, hidden ones, lags, and the order's keys.
    keys = [c.upper() for c in source] + list(hidden) + (["_N_"] if "_N_" in step.wanted else []) + [tuple(o) for o in offsets] + [f"s{i}" for i in range(len(order))]
    by = step.by_column().upper() if grouped else None
    for s in walk(step.block.statements):
        for t in s.data.get("targets", ()) if s.kind == "output" else ():
            if key_of(t) not in step.refs:
                raise StepError("REQ_INVALID_OUTPUT_TARGETS", f"no target {t}", "resolve outputs", s.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(T.StructType.fromJson(json.loads(schema_json)))
        state = program.start()
        number, group = 0, NotImplemented
        for batch in batches:
            outs: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = dict(zip(keys, r, strict=True))
                if grouped and v[by] != group:
                    group, state = v[by], program.start()
                for target, after in program.row(state, v):
                    outs.append((target, number, *(v[c] for c in places), *map(after.get, program.names)))
                    number += 1
                if state.stopped:
                    break
            columns = list(zip(*outs, strict=True)) if outs else [()] * len(wanted)
            yield pa.RecordBatch.from_arrays([pa.array([program.fit(x, f.type) for x in c], f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)
            if state.stopped:
                return

    result = ordered.mapInArrow(run, schema)
    finished = {}
    for key in step.refs:
        picked = [F.col(f"v{i}").alias(n) for i, (_, n) in enumerate(names)]
        hidden = (*[f"__{c}" for c in places], "__o0")
        frame = result.where(F.col("t") == key).select(*picked, *hidden)
        frame = V.snap_frame(frame, [n for _, n in names], [F.col(c) for c in hidden]) if step.options.snap_floats else frame
        finished[key] = shape(step, key, Dataset(frame, hidden))
    return finished


def step_window(step):
    from pyspark.sql import Window

    return Window.orderBy(*ascending(step.p.order))
