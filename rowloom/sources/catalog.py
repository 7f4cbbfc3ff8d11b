"""The session catalog: ordered datasets under case-insensitive names."""

from __future__ import annotations

import re
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN = "__"


@dataclass(frozen=True)
class Dataset:
    """A DataFrame, the hidden columns that order its rows, and its label."""

    frame: DataFrame
    order: tuple[str, ...] = ()
    label: str | None = None
    name: str = ""

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if not c.startswith(HIDDEN)]

    def visible(self, ordered: bool = True) -> DataFrame:
        frame = self.frame.orderBy(*[F.col(c).asc_nulls_last() for c in self.order]) if ordered and self.order else self.frame
        return frame.select(*[F.col(f"`{c}`") for c in self.columns])

    def with_(self, **changes) -> Dataset:
        return replace(self, **changes)


def key_of(name: str) -> str:
    key = name.strip().upper()
    return key[5:] if key.startswith("WORK.") else key


def display_of(name: str) -> str:
    name = name.strip()
    return name[5:] if name.upper().startswith("WORK.") else name


def reserved(name: str) -> bool:
    return key_of(name).startswith("DICTIONARY")


def ingest(spark: SparkSession, data, name: str = "", order: list[str] | None = None) -> Dataset:
    """Spark, Arrow, pandas or polars frames, or a list of dicts, with the order of their rows; ``order`` names columns that order a Spark frame."""
    if isinstance(data, Dataset):
        return data
    if not isinstance(data, DataFrame):
        if isinstance(data, list):
            data = pa.Table.from_pylist(data)
        elif not isinstance(data, pa.Table):
            data = data.to_arrow() if hasattr(data, "to_arrow") else pa.Table.from_pandas(data, preserve_index=False)
        notes = {f.name: {k.decode(): x.decode("utf-8", "replace") for k, x in f.metadata.items() if not k.startswith(b"PARQUET:")} for f in data.schema if f.metadata}
        memlabel = (data.schema.metadata or {}).get(b"memlabel", b"").decode() or None
        data = data.append_column("__o0", pa.array(range(data.num_rows), pa.int64()))
        frame = spark.createDataFrame(_narrow(data))
        for c, known in notes.items():
            frame = frame.withMetadata(c, known)
        return Dataset(frame, ("__o0",), memlabel, name)
    hidden = [c for c in data.columns if c.startswith(HIDDEN)]
    frame = data.drop(*hidden)
    if order:
        frame = frame.withColumns({f"__o{i}": F.col(f"`{c}`") for i, c in enumerate(order)})
        return Dataset(frame, tuple(f"__o{i}" for i in range(len(order))), None, name)
    return Dataset(frame.withColumn("__o0", _place(frame)), ("__o0",), None, name)


# Logical operators after which rows lie in no order that another run of the plan must repeat.
SHUFFLED = frozenset("Join Aggregate Distinct Intersect Except Window Repartition RepartitionByExpression RebalancePartitions".split())


def _place(frame: DataFrame):
    """A number that orders the rows: their place, where each run of the plan reads them alike (files, ranges, sorted results), else a hash of the row."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", frame._jdf.queryExecution().optimizedPlan().toString(), re.M)
    top = next((x for x in nodes if x in SHUFFLED or x == "Sort"), None)
    if top in (None, "Sort") or not frame.columns:
        return F.monotonically_increasing_id()
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") if frame.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in frame.columns])


def _narrow(table: pa.Table) -> pa.Table:
    """Types that Spark lacks: unsigned integers widen, dictionaries decode, null columns stay null."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.date64(): pa.date32()}
    for i, f in enumerate(table.schema):
        kind = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        kind = wider.get(kind, kind)
        if kind != f.type:
            table = table.set_column(i, pa.field(f.name, kind, metadata=f.metadata), table.column(i).cast(kind))
    return table


@dataclass
class Catalog(MutableMapping):
    spark: SparkSession
    items_: dict[str, Dataset] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Dataset:
        key = key_of(name)
        if key in ("DICTIONARY.TABLES", "DICTIONARY.COLUMNS"):
            return self.dictionary(key[11:].lower())
        return self.items_[key]

    def __setitem__(self, name: str, data) -> None:
        if reserved(name):
            raise ValueError(f"{name} is a reserved name")
        self.items_[key_of(name)] = ingest(self.spark, data, display_of(name)).with_(name=display_of(name))

    def __delitem__(self, name: str) -> None:
        del self.items_[key_of(name)]

    def __iter__(self) -> Iterator[str]:
        return iter([d.name for d in self.items_.values()])

    def __len__(self) -> int:
        return len(self.items_)

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and (key_of(name) in self.items_ or key_of(name) in ("DICTIONARY.TABLES", "DICTIONARY.COLUMNS"))

    def dictionary(self, which: str) -> Dataset:
        """Metadata tables. Row counts run one job, and only when ``tables`` is asked for."""
        rows: list[tuple] = []
        if which == "tables":
            counts = [d.frame.agg(F.count("*").alias("n")).withColumn("i", F.lit(i)) for i, d in enumerate(self.items_.values())]
            found = {r["i"]: r["n"] for r in reduce(lambda a, b: a.union(b), counts).collect()} if counts else {}  # one job, a row a dataset
            for i, (k, d) in enumerate(self.items_.items()):
                rows.append(("WORK", k, "DATA", d.label or "", found[i], len(d.columns)))
            schema = "LIBNAME string, MEMNAME string, MEMTYPE string, MEMLABEL string, NOBS long, NVAR long, __o0 long"
        elif which == "columns":
            for k, d in self.items_.items():
                for i, c in enumerate(d.columns):
                    f = d.frame.schema[c]
                    kind = "char" if f.dataType.typeName() == "string" else "num"
                    rows.append(("WORK", k, "DATA", c, kind, i + 1, (f.metadata or {}).get("label", ""), "", ""))
            schema = "LIBNAME string, MEMNAME string, MEMTYPE string, NAME string, TYPE string, VARNUM long, LABEL string, FORMAT string, INFORMAT string, __o0 long"
        else:
            raise KeyError(which)
        return Dataset(self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema), ("__o0",), None, f"dictionary.{which}")
