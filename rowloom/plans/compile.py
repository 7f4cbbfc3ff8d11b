"""A step as DataFrames: a symbolic run over its statements.

Each assignment adds a column; control flow becomes guards; OUTPUT records the guard and the variables of that moment.
State across rows becomes windows: ``_n_``, FIRST./LAST., END=, source-owned lag/lead/shift, sum statements (with a reset
under a FIRST. flag), retained variables that only carry their last value, STOP under a stateless condition. Steps
with any other state go to the ordered row loop of :mod:`rowloom.plans.rowloop`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import LogEntry, StepError
from ..functions import formats
from ..functions import values as V
from ..functions.values import Value, lit, type_of
from ..operators import whole_order
from ..operators.inputs import Prepared, ascending, group_flags, need, quoted, read_inputs, resolve, slice_rows
from ..sources.catalog import Catalog, Dataset, display_of, key_of, reserved
from .ast import Block, Call, Literal, Name, Statement, expressions, in_statement, walk
from .typed import NeedsRowLoop, Scope, evaluate

UNROLL = 64
PROBED = 20


@dataclass
class Options:
    snap_floats: bool = True  # exported doubles become the shortest rounding within 1e-12
    retain_initial: bool = False  # honour initial values after retained names


@dataclass
class Emission:
    targets: list[str]
    guard: Column | None
    variables: dict[str, Value]


@dataclass
class Step:
    block: Block
    catalog: Catalog
    formats: formats.Catalog
    generated: dict[str, Dataset]
    options: Options = field(default_factory=Options)
    functions: dict = field(default_factory=dict)
    log: list[LogEntry] = field(default_factory=list)

    # ---- analysis

    def prepare(self) -> None:
        b = self.block
        every = list(walk(b.statements))
        for s in every:
            if s.kind == "skipped":
                raise StepError("RUNTIME_RUST_STATEMENT_UNSUPPORTED", f"{s.data['head']} statements are not supported", "execute", s.text)
        inputs = [s for s in b.statements if s.kind in ("set", "merge")]
        if len(inputs) != 1:
            raise StepError("VALIDATE_SOURCE_REQUIRED", "a step needs one set or merge statement", "validate", b.text)
        self.input = inputs[0]
        bys = [s for s in b.statements if s.kind == "by"]
        self.by = bys[-1].data["names"] if bys else []
        self.arrays = {s.data["name"]: s.data["members"] for s in every if s.kind == "array"}
        self.retained = [n for s in b.statements if s.kind == "retain" for n in s.data["names"]]
        self.initial = {n.upper(): v for s in b.statements if s.kind == "retain" for n, v in s.data["initial"].items()}
        self.where = next((s for s in reversed(b.statements) if s.kind == "where"), None)
        self.wanted = {e.name.upper() for s in every for e in in_statement(s) if isinstance(e, Name)}
        self.targets()

    def targets(self) -> None:
        b = self.block
        keys = [key_of(t.name) for t in b.targets]
        if len(set(keys)) < len(keys):
            raise StepError("VALIDATE_DUPLICATE_DATA_TARGET", "a target is named twice", "validate", b.text)
        refs = {key_of(t.name): t for t in b.targets}
        top = [s for s in b.statements if s.kind == "output" and s.data["targets"]]
        for s in top:
            for t in s.data["targets"]:
                refs.setdefault(key_of(t), type(b.targets[0])(t))
        for r in refs.values():
            if reserved(r.name):
                raise StepError("VALIDATE_RESERVED_OUTPUT_TARGET", f"{r.name} is a reserved name", "validate", b.text)
            if "in" in r.options:
                raise StepError("PARSE_UNSUPPORTED_STATEMENT", "in= is for inputs", "validate", b.text)
        self.refs = refs
        self.explicit = any(s.kind == "output" for s in walk(b.statements))
        self.default = key_of(top[0].data["targets"][0]) if top else keys[0]

    # ---- the symbolic run

    def run(self) -> dict[str, Dataset]:
        self.prepare()
        self.p = group_flags(read_inputs(self.input, self.catalog, self.by, self.generated), self.wanted)
        self.labels_by_column()
        self.frame = self.p.frame
        self.counter = 0
        self.source = {c.upper(): Value(quoted(c), type_of(self.frame.schema[c].dataType)) for c in self.p.columns}
        self.types = {c.upper(): self.frame.schema[c].dataType for c in self.p.columns}
        self.env: dict[str, Value] = dict(self.source)
        for name, column in self.p.hidden.items():
            kind = "str" if column == "__dsname" else "bool" if column.startswith(("__first", "__last")) else "int"
            self.env[name] = Value(F.col(column), kind)
        self.names: dict[str, str] = {c.upper(): c for c in self.p.columns}
        self.step_names()
        if "_N_" in self.wanted:
            self.frame = whole_order.number(self.frame, self.p.order, "__n").withColumn("__n", F.col("__n").cast("double"))
        self.env["_N_"] = Value(F.col("__n"), "num")
        self.env["_ERROR_"] = lit(0.0)
        self.emissions: list[Emission] = []
        try:
            self.offsets()
            self.check_state()
            if self.where is not None:
                self.frame = self.frame.where(V.boolean(self.eval(self.where.data["expr"])))
            self.alive: Column | None = None
            self.stateful = any(s.kind in ("sum", "stop") for s in walk(self.block.statements)) or bool(self.retained)
            self.statements(self.block.statements, None)
            emissions = self.emissions if self.explicit else [Emission([self.default], self.alive, dict(self.env))]
        except NeedsRowLoop as why:
            from .rowloop import run_loop

            self.log.append(LogEntry("info", "RUNTIME_ROW_LOOP", "execute", f"rows are visited in order: {why}"))
            return run_loop(self)
        return {k: self.finish(k, emissions) for k in self.refs}

    def step_names(self) -> None:
        """Variables the step defines, in order of first definition."""
        def add(name: str) -> None:
            if name.upper() not in self.p.hidden and name.upper() not in ("_N_", "_ERROR_"):
                self.names.setdefault(name.upper(), name)

        for s in walk(self.block.statements):
            if s.kind in ("assign", "sum") and "var" in s.data or s.kind == "do":
                add(s.data["var"])
            elif s.kind == "array":
                for n in s.data["members"]:
                    add(n)
            elif s.kind == "retain":
                for n in s.data["names"]:
                    add(n)
        for k in self.names:
            self.env.setdefault(k, lit(None))

    def by_column(self) -> str:
        return need(self.by[0], list(self.p.columns))

    def scope(self) -> Scope:
        return Scope(self.env, self.arrays, self.formats, self.offset, self.functions, self.probe)

    def probe(self, args: list[Value]) -> list[tuple]:
        """What the first rows hold (``PROBED`` at most, for the type of a function's result)."""
        columns = [a.col.cast("double") if a.type in ("num", "null") else a.col for a in args]
        return [tuple(r) for r in self.frame.select(*[c.alias(f"a{i}") for i, c in enumerate(columns)]).limit(PROBED).collect()]

    def eval(self, e) -> Value:
        return evaluate(e, self.scope())

    def keep(self, col: Column, kind: str) -> Value:
        name = f"__v{self.counter}"
        self.counter += 1
        self.frame = self.frame.withColumn(name, col)
        return Value(F.col(name), kind)

    # lag, lead and shift of source columns: on all prepared rows, before WHERE
    def offset_spec(self, e: Call) -> tuple[str, int, Value] | None:
        quoted_name = isinstance(e.args[0], Literal) and isinstance(e.args[0].value, str)
        if not (quoted_name or (isinstance(e.args[0], Name) and e.name != "shift")):
            return None
        name = e.args[0].value if quoted_name else e.args[0].name
        rest = [a.value if isinstance(a, Literal) else NotImplemented for a in e.args[1:]]
        if NotImplemented in rest:
            return None
        n = int(rest[0]) if rest and rest[0] is not None else 1
        n = -n if e.name == "lag" else n
        return name, n, lit(rest[1] if len(rest) > 1 else None)

    def offsets(self) -> None:
        self.offset_columns: dict[tuple, Value] = {}
        self.queues: dict[int, Call] = {}
        moves: list[tuple[str, str, Column, int]] = []
        moved: list[tuple[tuple, Value, Value, str | None]] = []
        for s in walk(self.block.statements):
            for e in in_statement(s):
                if isinstance(e, Call) and e.name in ("lag", "lead", "shift") and e.args:
                    spec = self.offset_spec(e)
                    if spec is None:
                        self.queued(s, e)
                        continue
                    name, n, default = spec
                    source = self.source.get(name.upper())
                    at = (name.upper(), n, default.literal)
                    if at in self.offset_columns or at in [m[0] for m in moved]:
                        continue
                    if source is None:
                        self.offset_columns[at] = default
                        continue
                    here = len(moves) if n else None
                    moves += [(f"__is{here}", f"__at{here}", source.col, n)] if n else []
                    moved.append((at, source, default, here))
        if moves:
            self.frame = whole_order.neighbours(self.frame, self.p.order, moves)
        for at, source, default, here in moved:
            kind = V.join(source.type, default.type)
            col = V.cast(source, kind) if here is None else F.when(F.col(f"__is{here}"), V.cast(Value(F.col(f"__at{here}"), source.type), kind)).otherwise(V.cast(default, kind))
            self.offset_columns[at] = self.keep(col, kind)

    def queued(self, s: Statement, e: Call) -> None:
        """Note a lag of an expression; one that every row executes, alone in its queue, is the neighbour's value."""
        rest = [a.value if isinstance(a, Literal) else NotImplemented for a in e.args[1:]]
        n = int(rest[0]) if rest and isinstance(rest[0], (int, float)) else 1
        if e.name == "shift" and n < 0:
            n = -n
        elif e.name != "lag":
            raise NeedsRowLoop(f"{e.name} of an expression")
        plain = NotImplemented not in rest and n > 0 and s.kind in ("assign", "if", "subset") and any(x is s for x in self.block.statements)
        if not plain or n in self.queues or any(x.kind == "stop" for x in walk(self.block.statements)):
            raise NeedsRowLoop(f"{e.name} of an expression")
        self.queues[n] = e

    def offset(self, e: Call) -> Value:
        spec = self.offset_spec(e)
        if spec is None:
            n = next((n for n, x in self.queues.items() if x is e), None)
            if n is None or self.alive is not None:
                raise NeedsRowLoop(f"{e.name} of an expression")
            source, default = self.eval(e.args[0]), lit(e.args[2].value if len(e.args) > 2 else None)
            kind = V.join(source.type, default.type)
            self.frame = whole_order.neighbours(self.frame, self.p.order, [(f"__qis{n}", f"__qat{n}", V.cast(source, kind), -n)])
            return Value(F.when(F.col(f"__qis{n}"), F.col(f"__qat{n}")).otherwise(V.cast(default, kind)), kind)
        return self.offset_columns[spec[0].upper(), spec[1], spec[2].literal]

    def check_state(self) -> None:
        """Raise where windows can't express the step's state."""
        sums = {s.data["var"].upper() for s in walk(self.block.statements) if s.kind == "sum"} - set(self.source)
        kept = {n.upper() for n in self.retained}
        reads: dict[str, int] = {}
        for s in walk(self.block.statements):
            if s.kind in ("sum", "stop") and any(x.kind == "do" and s in list(walk(x.body)) for x in walk(self.block.statements)):
                raise NeedsRowLoop(f"{s.kind} in a loop")
            used = {e.name.upper() for e in in_statement(s) if isinstance(e, Name)}
            if s.kind == "sum" and used & (sums | kept):
                raise NeedsRowLoop(f"the increment of {s.data['var']} depends on state")
            if s.kind == "assign" and s.data.get("var", "").upper() in kept and used & (kept | sums):
                raise NeedsRowLoop(f"{s.data['var']} depends on its last value")
            if s.kind in ("if", "subset") and used & kept:
                raise NeedsRowLoop("a condition depends on a retained variable")
            if s.kind == "stop" and kept:
                raise NeedsRowLoop("stop beside retained variables")
            for u in used:
                reads[u] = reads.get(u, 0) + 1
        if self.where is not None and any(isinstance(e, Name) and e.name.upper() in kept | sums for e in expressions(self.where.data["expr"])):
            raise NeedsRowLoop("where depends on state")
        if self.options.retain_initial and self.initial:
            raise NeedsRowLoop("initial values of retained variables")
        if kept & set(self.source) or kept & sums:
            raise NeedsRowLoop("a retained source column or sum")
        self.sums, self.kept = sums, kept
        seen: set[str] = set()
        for s in walk(self.block.statements):  # a sum read before its statement shows the last row's value
            if s.kind == "sum":
                if s.data["var"].upper() in seen and s.data["var"].upper() in sums:
                    raise NeedsRowLoop(f"two sums into {s.data['var']}")
                seen.add(s.data["var"].upper())
            elif s.kind == "assign" and s.data.get("var", "").upper() in seen & sums:
                raise NeedsRowLoop(f"{s.data['var']} is set after its sum")
            elif {e.name.upper() for e in in_statement(s) if isinstance(e, Name)} & (sums - seen):
                raise NeedsRowLoop("a sum is read before it is made")
        counts: dict[str, int] = {}
        for s in walk(self.block.statements):
            if s.kind == "assign" and s.data.get("var", "").upper() in kept:
                counts[s.data["var"].upper()] = counts.get(s.data["var"].upper(), 0) + 1
        if any(c > 1 for c in counts.values()):
            raise NeedsRowLoop("a retained variable has two assignments")
        for s in walk(self.block.statements):
            if s.kind == "assign" and s.data.get("var", "").upper() in sums and not isinstance(s.data["expr"], Literal):
                raise NeedsRowLoop(f"{s.data['var']} is reset to an expression")

    def statements(self, body: list[Statement], guard: Column | None) -> None:
        for s in body:
            getattr(self, f"do_{s.kind}", lambda s, g: None)(s, guard)

    def live(self, guard: Column | None) -> Column | None:
        if self.alive is None:
            return guard
        return self.alive if guard is None else self.alive & guard

    def assign(self, name: str, v: Value, guard: Column | None) -> None:
        key = name.upper()
        if v.type == "other":
            raise V.refuse("nested values can't be assigned")
        old = self.env.get(key, lit(None))
        if guard is None:
            self.env[key] = v if v.is_literal else self.keep(v.col, v.type)
            return
        kind = V.join(old.type, v.type)
        self.env[key] = self.keep(F.when(guard, V.cast(v, kind)).otherwise(V.cast(old, kind)), kind)

    def do_assign(self, s: Statement, guard: Column | None) -> None:
        v = self.eval(s.data["expr"])
        if "var" in s.data:
            key = s.data["var"].upper()
            if key in self.sums:
                self.resets = getattr(self, "resets", {})
                self.resets[key] = (guard, v)
                return
            if key in self.kept:
                carried = v.col if guard is None else F.when(self.live(guard), v.col)
                self.frame = whole_order.last_value(self.frame, self.p.order, carried, f"__v{self.counter}")
                self.env[key] = Value(F.col(f"__v{self.counter}"), v.type)
                self.counter += 1
                return
            self.assign(s.data["var"], v, guard)
            return
        if s.data["array"] not in self.arrays:
            raise V.refuse(f"unknown array: {s.data['array']}")
        names, at = self.arrays[s.data["array"]], self.eval(s.data["index"])
        if at.is_literal:
            i = int(at.literal) if isinstance(at.literal, (int, float)) else 0
            if not 1 <= i <= len(names):
                raise V.refuse(f"array index out of bounds: {s.data['array']}[{i}]")
            self.assign(names[i - 1], v, guard)
            return
        place = V.number(at).cast("int")
        for i, n in enumerate(names):
            here = place == i + 1
            self.assign(n, v, here if guard is None else guard & here)

    def do_sum(self, s: Statement, guard: Column | None) -> None:
        key, v = s.data["var"].upper(), self.eval(s.data["expr"])
        step = V.number0(v)
        live = self.live(guard)
        if key not in self.sums:  # a source column: this row's own value is the base
            base = V.number0(self.env[key])
            self.assign(s.data["var"], Value(base + step, "num"), guard)
            return
        partition: list[Column] = []
        base = F.lit(0.0)
        if key in getattr(self, "resets", {}):
            reset, value = self.resets[key]
            partition, base = self.reset_groups(reset), V.number0(value)
        step = step if live is None else F.when(live, step).otherwise(0.0)
        if partition:
            order = Window.partitionBy(*partition).orderBy(*ascending(self.p.order)).rowsBetween(Window.unboundedPreceding, 0)
            total = base + F.sum(step).over(order)
        else:
            total = base + self.running_sum(step)
        self.env[key] = self.keep(total if guard is None else F.when(guard, total), "num")

    def reset_groups(self, reset: Column | None) -> list[Column]:
        """The windows within which a sum runs, if its resets are under ``first.`` of the first key; else runs between resets."""
        flag = self.p.hidden.get(f"FIRST.{self.p.by[0].upper()}") if self.p.by else None
        if reset is None:
            raise NeedsRowLoop("a sum is reset on every row")
        if flag and str(reset) == str(V.boolean(Value(F.col(flag), "bool"))):
            return [quoted(self.p.by[0])]
        return [self.running_sum(reset.cast("long"))]

    def running_sum(self, step: Column) -> Column:
        name = f"__v{self.counter}"
        self.counter += 1
        self.frame = whole_order.running_sum(self.frame, self.p.order, step, name)
        return F.col(name)

    def do_if(self, s: Statement, guard: Column | None) -> None:
        hit = self.keep(V.boolean(self.eval(s.data["cond"])), "bool").col if not self.plain_flag(s) else V.boolean(self.eval(s.data["cond"]))
        self.statements(s.body, hit if guard is None else guard & hit)
        self.statements(s.orelse, ~hit if guard is None else guard & ~hit)

    def plain_flag(self, s: Statement) -> bool:
        return isinstance(s.data["cond"], Name) and s.data["cond"].name.upper() in self.p.hidden

    def drop_rows(self, stays: Column, guard: Column | None) -> None:
        if guard is None and not self.emissions and not self.stateful and self.alive is None:
            self.frame = self.frame.where(stays)  # nothing else looks at the row: filter, so that it can be pushed down
            return
        stays = stays if guard is None else ~guard | stays
        self.alive = self.keep(stays if self.alive is None else self.alive & stays, "bool").col

    def do_subset(self, s: Statement, guard: Column | None) -> None:
        self.drop_rows(V.boolean(self.eval(s.data["cond"])), guard)

    def do_delete(self, s: Statement, guard: Column | None) -> None:
        self.drop_rows(F.lit(False), guard)

    def do_stop(self, s: Statement, guard: Column | None) -> None:
        """Rows after the first that stops go; that row itself is finished without the statements after this one."""
        hit = self.live(guard)
        if hit is None:
            hit = F.lit(True)
        self.frame = whole_order.earlier_max(self.frame, self.p.order, hit.cast("int"), "__stop").withColumn("__stop", F.coalesce("__stop", F.lit(0)))
        after = [x for x in walk(self.block.statements) if x.text and self.block.statements.index(x) > 0] if s in self.block.statements else []
        self.frame = self.frame.where("__stop = 0")
        if after and self.block.statements[-1] is not s and guard is None:
            raise NeedsRowLoop("statements follow stop")

    def do_output(self, s: Statement, guard: Column | None) -> None:
        targets = [key_of(t) for t in s.data["targets"]] or list(self.refs)
        for t in targets:
            if t not in self.refs:
                raise StepError("REQ_INVALID_OUTPUT_TARGETS", f"no target {t}", "resolve outputs", s.text)
        self.emissions.append(Emission(list(dict.fromkeys(targets)), self.live(guard), dict(self.env)))

    def do_do(self, s: Statement, guard: Column | None) -> None:
        low, high = self.eval(s.data["low"]), self.eval(s.data["high"])
        if low.is_literal and high.is_literal and isinstance(low.literal, (int, float)) and isinstance(high.literal, (int, float)):
            a, b = int(low.literal), int(high.literal)
            if b - a + 1 > UNROLL:
                raise NeedsRowLoop("a long loop")
            for i in range(a, b + 1):
                self.assign(s.data["var"], lit(i), guard)
                self.statements(s.body, guard)
            return
        raise NeedsRowLoop("a loop with computed bounds")

    # ---- outputs

    def labels_by_column(self) -> None:
        self.labels = {}
        for s in self.block.statements:
            if s.kind == "label":
                self.labels |= {k.upper(): v for k, v in s.data["pairs"].items()}

    def finish(self, key: str, emissions: list[Emission]) -> Dataset:
        mine = [e for e in emissions if key in e.targets]
        kinds: dict[str, str] = {}
        for k in self.names:
            kind = "null"
            for e in mine or [Emission([], None, self.env)]:
                kind = V.join(kind, e.variables.get(k, lit(None)).type)
            kinds[k] = kind
        order = list(self.p.order)
        spare = {c: f"__x{i}" for i, c in enumerate(order) if not c.startswith("__")}
        hidden = [F.col(f"`{c}`").alias(spare.get(c, c)) for c in order]
        order = [spare.get(c, c) for c in order]

        def row(e: Emission) -> list[Column]:
            return [self.export(k, e.variables.get(k, lit(None)), kinds[k]).alias(n) for k, n in self.names.items()]

        if not mine:
            frame = self.frame.where(F.lit(False)).select(*row(Emission([], None, self.env)), *hidden)
        elif len(mine) == 1:
            frame = self.frame if mine[0].guard is None else self.frame.where(mine[0].guard)
            frame = frame.select(*row(mine[0]), *hidden)
        else:  # several outputs a row: in statement order
            items = [F.struct(F.lit(i).alias("__e"), *row(e)) for i, e in enumerate(mine)]
            items = [x if e.guard is None else F.when(e.guard, x) for x, e in zip(items, mine, strict=True)]
            frame = self.frame.select(*hidden, F.explode(F.array_compact(F.array(*items))).alias("__row"))
            frame = frame.select(*[F.col(f"__row.`{n}`").alias(n) for n in self.names.values()], *order, F.col("__row.__e").alias("__e"))
            order.append("__e")
        names, places = list(self.names.values()), [F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]
        frame = V.snap_frame(frame, names, places) if self.options.snap_floats else frame.select(*[quoted(n) for n in names], *places)
        return shape(self, key, Dataset(frame, tuple(f"__o{i}" for i in range(len(order)))))

    def export(self, key: str, v: Value, kind: str) -> Column:
        """The value as the output has it, but for the snapping of doubles."""
        return v.col if v.type == "other" or (key in self.source and v is self.source[key] and kind == v.type) else V.cast(v, kind)


def shape(step: Step, key: str, data: Dataset) -> Dataset:
    """KEEP, DROP and RENAME statements, then the target's own options, then labels."""
    columns = data.columns
    every = step.block.statements
    keeps = [n for s in every if s.kind == "keep" for n in s.data["names"]]
    drops = [n for s in every if s.kind == "drop" for n in s.data["names"]]
    renames = {a: b for s in every if s.kind == "rename" for a, b in s.data["pairs"].items()}
    secret = {h.upper() for h in step.p.hidden} | {"_N_", "_ERROR_"} | {f"{side}.{k.upper()}" for k in step.by for side in ("FIRST", "LAST")}
    kept = {need(n, columns) for n in keeps if n.upper() not in secret}
    if keeps:
        columns = [c for c in columns if c in kept]
    gone = {need(n, data.columns) for n in drops if n.upper() not in secret}
    columns = [c for c in columns if c not in gone]
    names = {c: c for c in columns}
    for old, new in renames.items():
        found = resolve(old, columns)
        if found is None:
            raise StepError("RUNTIME_RENAME_STATEMENT_INVALID", f"rename: no column {old}", "validate")
        names[found] = new
    if len({n.upper() for n in names.values()}) < len(names):
        raise StepError("RUNTIME_RENAME_STATEMENT_INVALID", "rename: two columns get one name", "validate")
    options = step.refs[key].options
    for k in ("keep", "drop"):
        if k in options:
            chosen = {need(n, list(names.values())) for n in options[k]}
            names = {c: n for c, n in names.items() if (n in chosen) == (k == "keep")}
    for old, new in options.get("rename", {}).items():
        found = next((c for c, n in names.items() if n.upper() == old.upper()), None)
        if found is None:
            raise StepError("RUNTIME_DATASET_OPTION_INVALID", f"rename=: no column {old}", "validate")
        names[found] = new
    for n in step.labels:
        if resolve(n, list(names)) is None and resolve(n, list(names.values())) is None and n not in step.names:
            raise StepError("VALIDATE_COLUMN_NOT_FOUND", f"label: no column {n}", "validate")
    picked = []
    for c, n in names.items():
        label = step.labels.get(c.upper()) or step.labels.get(n.upper())
        meta = dict(data.frame.schema[c].metadata or {})
        picked.append(quoted(c).alias(n, metadata=meta | ({"label": label} if label else {})))
    frame = data.frame.select(*picked, *data.order)
    if "where" in options:  # the rules of statements, not of a filter
        types = {n.upper(): Value(quoted(n), type_of(frame.schema[n].dataType)) for n in names.values()}
        frame = frame.where(V.boolean(where_statement(options["where"], Scope(types, {}, step.formats))))
    if options.get("firstobs", 1) > 1 or "obs" in options:
        frame = slice_rows(frame, list(data.order), options.get("firstobs", 1), options.get("obs"))
    return Dataset(frame, data.order, options.get("label"), display_of(step.refs[key].name))


def where_statement(e, scope: Scope) -> Value:
    from .ast import Binary, Unary

    if isinstance(e, Unary):
        return Value(V.missing(evaluate(e.arg, scope)), "bool", sure=True) if e.op == "isnull" else Value(~V.boolean(where_statement(e.arg, scope)), "bool", sure=True)
    if isinstance(e, Binary) and e.op in ("and", "or"):
        a, b = V.boolean(where_statement(e.left, scope)), V.boolean(where_statement(e.right, scope))
        return Value(a & b if e.op == "and" else a | b, "bool", sure=True)
    return evaluate(e, scope)


def prepared_of(step: Step) -> tuple[Prepared, DataFrame]:
    return step.p, step.frame
