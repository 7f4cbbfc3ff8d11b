"""Sessions: a catalog of ordered datasets, programs, column helpers and SQL."""

from __future__ import annotations

import inspect
import re
import time
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .diagnostics import EMPTY_NOTICE, MISSING_NOTICE, LogEntry, Notice, StepError, SubmitResult
from .functions.formats import Catalog as Formats
from .operators import helpers
from .plans.ast import Literal, expressions, in_statement, walk
from .plans.compile import Options, Step
from .plans.parser import parse_program
from .sources.catalog import Catalog, Dataset, display_of, ingest, key_of, reserved

MODES = ("auto", "rust", "python")


class Session:
    def __init__(self, spark: SparkSession | None = None, macro_hook: Callable[[str], str] | None = None, **options):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.spark.conf.set("spark.sql.timeType.enabled", "true")  # TIME columns are off by default
        self.datasets = Catalog(self.spark)
        self.formats = Formats()
        self.macro_hook = macro_hook
        self.options: dict[str, object] = {}
        for k, v in options.items():
            self.set_option(k, v)

    # ---- catalog

    @property
    def work(self) -> Catalog:
        return self.datasets

    def load(self, name: str, data, order: str | list[str] | None = None) -> DatasetView:
        """Register ``data``; ``order`` names the columns that order a Spark frame's rows (else their place does)."""
        if order is not None:
            data = ingest(self.spark, data, display_of(name), order.split() if isinstance(order, str) else list(order))
        self.datasets[name] = data
        return self[name]

    def loads(self, mapping: dict | None = None, **named) -> None:
        for k, v in ((mapping or {}) | named).items():
            self.load(k, v)

    def unload(self, *names: str, missing_ok: bool = True) -> None:
        for n in names:
            if n in self.datasets:
                del self.datasets[n]
            elif not missing_ok:
                raise KeyError(n)

    delete = unload

    def read_parquet(self, name: str, path: str) -> DatasetView:
        return self.load(name, self.spark.read.parquet(path))

    def read_csv(self, name: str, path: str, schema: str, **options) -> DatasetView:
        return self.load(name, self.spark.read.schema(schema).options(**{"header": True} | options).csv(path))

    def write_parquet(self, name: str, path: str, mode: str = "errorifexists") -> None:
        self.datasets[name].visible(ordered=False).write.mode(mode).parquet(path)

    def __getitem__(self, name: str) -> DatasetView:
        if name not in self.datasets:
            raise KeyError(name)
        return DatasetView(self, name)

    dataset = __getitem__

    def frame(self, name: str, ordered: bool = False) -> DataFrame:
        return self.datasets[name].visible(ordered)

    def to_arrow(self, name: str):
        """The rows in order; columns carry their metadata (labels among it), the table its label."""
        data = self.datasets[name]
        frame = data.visible(True)
        table = frame.toArrow()
        fields = [f.with_metadata({k: str(x) for k, x in frame.schema[f.name].metadata.items()}) if frame.schema[f.name].metadata else f for f in table.schema]
        return table.cast(pa.schema(fields, {"memlabel": data.label} if data.label else None)) if fields else table

    def to_pandas(self, name: str):
        return self.to_arrow(name).to_pandas()

    def to_polars(self, name: str):
        import polars  # an optional package

        return polars.from_arrow(self.to_arrow(name))

    def to_pylist(self, name: str) -> list[dict]:
        return self.to_arrow(name).to_pylist()

    def convert(self, name: str, kind: str):
        """``arrow_table``, ``pylist`` or ``pandas``."""
        found = {"arrow_table": self.to_arrow, "pylist": self.to_pylist, "pandas": self.to_pandas}.get(kind)
        if found is None:
            raise StepError("CONVERT_OUTPUT_FORMAT_UNSUPPORTED", f"unknown format {kind}", "resolve outputs")
        return found(name)

    @staticmethod
    def list_supported_formats() -> list[str]:
        return ["arrow_table", "pylist", "pandas"]

    def check_format_support(self, kind: str) -> bool:
        return kind in self.list_supported_formats()

    def dictionary(self, which: str = "tables") -> DataFrame:
        return self.datasets.dictionary(which).visible(False)

    # ---- options and formats

    def set_option(self, name: str, value) -> None:
        self.options[name] = value

    def get_option(self, name: str, default=None):
        return self.options.get(name, default)

    def register_format(self, name: str, mapping: dict, namespace: str | None = None) -> None:
        self.formats.register_format(name, mapping, namespace)

    def register_informat(self, name: str, mapping: dict, kind: str | None = None) -> None:
        self.formats.register_informat(name, mapping, kind)

    # ---- programs

    def submit(self, code: str, backend: str = "auto", functions: dict | None = None, eager: bool = False, caller_depth: int = 1, display_result: bool = True, **datasets) -> SubmitResult:
        """Plan the steps of ``code``; outputs are lazy unless ``eager``. On an error no output of the call is published.

        With the option ``check_outputs`` every output is computed once without being kept, so that faults in rows are errors
        of the call too, and repeated BY values of MERGE are warned of. With ``print_log`` warnings and errors are printed.
        """
        result = self._submitted(code, backend, functions, eager, caller_depth + 1, datasets)
        result.display_result = display_result
        if self.get_option("print_log") and any(e.level != "info" for e in result.log):
            result.print_log()
        return result

    def _submitted(self, code: str, backend: str, functions: dict | None, eager: bool, caller_depth: int, datasets: dict) -> SubmitResult:
        log: list[LogEntry] = []
        times: list[tuple[str, float]] = []
        notices: list[Notice] = []
        generated: dict[str, Dataset] = {}
        began = time.time()
        source = code
        caller = inspect.currentframe()
        for _ in range(caller_depth):
            caller = caller.f_back
        found = {k: v for k, v in {**caller.f_globals, **caller.f_locals}.items() if callable(v) and not isinstance(v, type)} | (functions or {})
        try:
            if backend not in MODES:
                raise StepError("REQ_INVALID_EXECUTION_MODE", f"unknown backend {backend}", "split blocks")
            if functions is not None and any(not callable(f[0] if isinstance(f, tuple) else f) for f in functions.values()):
                raise StepError("RUNTIME_APPLY_FUNCTIONS_INVALID", "functions= takes callables, or pairs of callable and type", "validate")
            inputs = {key_of(k): ingest(self.spark, v, display_of(k)) for k, v in datasets.items()}
            source = self.macro_hook(code) if self.macro_hook else code
            blocks = parse_program(source)
            notices = _notices(blocks)
            times.append(("parse", time.time() - began))
            known = Options(snap_floats=bool(self.get_option("snap_floats", True)), retain_initial=bool(self.get_option("retain_initial", False)))
            for block in blocks:
                step = Step(block, self.datasets, self.formats, inputs | generated, known, found, log)
                made = step.run()
                if self.get_option("check_outputs"):
                    self._check(step, made)
                generated |= made
                times.append(("execute", time.time() - began))
            if eager:
                for k, d in generated.items():
                    generated[k] = d.with_(frame=d.frame.checkpoint())
        except StepError as e:
            return SubmitResult(False, {}, [*log, e.entry.located(source)], times, notices)
        except PySparkException as e:
            return SubmitResult(False, {}, [*log, LogEntry("error", "RUNTIME_EXPRESSION_EVALUATION_ERROR", "execute", str(e)[:500])], times, notices)
        for k, d in generated.items():
            self.datasets.items_[k] = d
        return SubmitResult(True, {d.name: d.visible(False) for d in generated.values()}, log, times, notices)

    @staticmethod
    def _check(step: Step, made: dict[str, Dataset]) -> None:
        for d in made.values():
            d.visible(False).write.format("noop").mode("overwrite").save()
        if step.p.repeats is not None and not step.p.repeats().isEmpty():
            step.log.append(LogEntry("warning", "RUNTIME_MERGE_REPEATED_BY_VALUES", "pre-evaluations", "BY values are repeated in more than one source of the merge", step.input.text))

    run = submit

    def include(self, path: str, **options) -> SubmitResult:
        return self.submit(Path(path).read_text(encoding="utf-8"), caller_depth=2, **options)

    # ---- column helpers

    def _put(self, source: str, data: Dataset, out: str | None, target: str | None) -> DatasetView:
        if out is not None and target is not None and key_of(out) != key_of(target):
            raise ValueError("out= and target= differ")
        name = out or target or source
        self.datasets[name] = data
        return self[name]

    def select(self, source: str, columns, out=None, target=None) -> DatasetView:
        return self._put(source, helpers.select(self.datasets[source], columns), out, target)

    keep = select

    def drop(self, source: str, columns, out=None, target=None) -> DatasetView:
        return self._put(source, helpers.drop(self.datasets[source], columns), out, target)

    def rename(self, source: str, mapping: dict, out=None, target=None) -> DatasetView:
        return self._put(source, helpers.rename(self.datasets[source], mapping), out, target)

    def where(self, source: str, condition: str, out=None, target=None) -> DatasetView:
        return self._put(source, helpers.where(self.datasets[source], condition), out, target)

    filter = where

    def apply_dataset_options(self, source: str, out=None, target=None, **options) -> DatasetView:
        return self._put(source, helpers.options(self.datasets[source], **options), out, target)

    apply_options = apply_dataset_options

    def sort(self, source: str, by, out=None, target=None, nodupkey: bool = False) -> DatasetView:
        return self._put(source, helpers.sort(self.datasets[source], by, nodupkey), out, target)

    def cast(self, source: str, kinds: dict, out=None, target=None) -> DatasetView:
        return self._put(source, helpers.cast(self.datasets[source], kinds), out, target)

    astype = cast

    def transpose(self, source: str, by, var, id=None, out=None, target=None) -> DatasetView:  # noqa: A002
        return self._put(source, helpers.transpose(self.datasets[source], by, var, id), out, target)

    def assign(self, source: str, out=None, target=None, **expressions) -> DatasetView:
        return self._put(source, helpers.assign(self.datasets[source], self.formats, **expressions), out, target)

    # ---- SQL

    def sql(self, query: str, out: str | None = None, target: str | None = None):
        """Spark SQL over the catalog. ``create table x as`` and ``out=`` publish the result; ``drop table x`` removes one."""
        text = query.strip().rstrip(";").strip()
        m = re.fullmatch(r"drop\s+table\s+(if\s+exists\s+)?([\w.]+)", text, re.I)
        if m:
            self.unload(m[2], missing_ok=bool(m[1]))
            return None
        m = re.match(r"create\s+(?:or\s+replace\s+)?table\s+([\w.]+)\s+as\s+", text, re.I)
        name = out or target
        if m:
            name, text = m[1], text[m.end() :]
        if name is not None and reserved(name):
            raise ValueError(f"{name} is a reserved name")
        frame = self.spark.sql(self._rewritten(text), **{self._argument(k): d.visible(False) for k, d in self._tables(text).items()})
        if name is None:
            return frame
        return self.load(name, frame)

    def _tables(self, text: str) -> dict[str, Dataset]:
        words = {w.upper() for w in re.findall(r"[A-Za-z_]\w*", text)}
        found = {k: d for k, d in self.datasets.items_.items() if k in words}
        for which in ("tables", "columns"):
            if re.search(rf"\bdictionary[._]{which}\b", text, re.I):
                found[f"DICTIONARY_{which.upper()}"] = self.datasets.dictionary(which)
        return found

    @staticmethod
    def _argument(key: str) -> str:
        return f"rl_{key.lower()}"

    def _rewritten(self, text: str) -> str:
        """Names of datasets after from, join or a comma there stand for the frames; quoted text stays as it is."""
        names = {k.lower() for k in self._tables(text)}
        out = []
        for i, part in enumerate(re.split(r"('[^']*')", text)):
            if i % 2:
                out.append(part.replace("{", "{{").replace("}", "}}"))
                continue
            part = part.replace("{", "{{").replace("}", "}}")
            part = re.sub(r"\bdictionary\.(tables|columns)\b", r"dictionary_\1", part, flags=re.I)
            table = rf"(?:work\.)?({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b(?!\.)"
            if names:
                alias = r"(?=\s+(?:as\s+)?(?!(?:on|where|group|order|having|limit|join|inner|left|right|full|cross|semi|anti|union|intersect|except|using|natural)\b)[A-Za-z_])"
                hit = lambda m: f"{m[1]}{{{self._argument(m[2].lower())}}}"
                part = re.sub(rf"(\b(?:from|join)\s+){table}{alias}", hit, part, flags=re.I)
                part = re.sub(rf"(\b(?:from|join)\s+){table}", lambda m: f"{hit(m)} AS {m[2]}", part, flags=re.I)
                part = re.sub(rf"(}}\s*(?:as\s+)?\w*\s*,\s*){table}{alias}", hit, part, flags=re.I)
                part = re.sub(rf"(}}\s*(?:as\s+)?\w*\s*,\s*){table}", lambda m: f"{hit(m)} AS {m[2]}", part, flags=re.I)
            out.append(part)
        return "".join(out)


def _notices(blocks) -> list[Notice]:
    """Rules on missing values that the program's literals rely on."""
    literals = [e.value for b in blocks for s in walk(b.statements) for x in in_statement(s) for e in expressions(x) if isinstance(e, Literal)]
    return [MISSING_NOTICE] * any(x is None for x in literals) + [EMPTY_NOTICE] * any(x == "" for x in literals if isinstance(x, str))


class DatasetView:
    """One dataset of a session; helpers return the view of what they made."""

    def __init__(self, session: Session, name: str):
        self.session, self.name = session, name

    @property
    def columns(self) -> list[str]:
        return self.session.datasets[self.name].columns

    @property
    def label(self) -> str | None:
        return self.session.datasets[self.name].label

    def frame(self, ordered: bool = False) -> DataFrame:
        return self.session.frame(self.name, ordered)

    def to_arrow(self):
        return self.session.to_arrow(self.name)

    def to_pandas(self):
        return self.session.to_pandas(self.name)

    def to_pylist(self) -> list[dict]:
        return self.session.to_pylist(self.name)

    def __getattr__(self, method: str):
        if method not in ("select", "keep", "drop", "rename", "where", "filter", "apply_dataset_options", "apply_options", "sort", "cast", "astype", "transpose", "assign"):
            raise AttributeError(method)
        return lambda *args, **named: getattr(self.session, method)(self.name, *args, **named)


def run(code: str, spark: SparkSession | None = None, functions: dict | None = None, **datasets) -> SubmitResult:
    """One program in a session of its own."""
    return Session(spark).submit(code, functions=functions, caller_depth=2, **datasets)


submit = run
