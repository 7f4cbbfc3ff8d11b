"""Formats (``put``), informats (``input``) and their catalogs."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .values import Value, refuse

# Date patterns by format name.
DATE_PATTERNS = {"yymmdd6": "yyMMdd", "yymmdd8": "yyyyMMdd", "yymmdd10": "yyyy-MM-dd", "e8601da": "yyyy-MM-dd"}
TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"


class Catalog:
    """Exact-match tables, numeric and character (``$``) ones apart."""

    def __init__(self):
        self.formats: dict[str, dict] = {}
        self.informats: dict[str, dict] = {}

    @staticmethod
    def key(name: str, character: bool) -> str:
        bare = name.strip().rstrip(".").lower().lstrip("$")
        if not bare:
            raise ValueError("a format needs a name")
        return ("$" if character else "") + bare

    def register_format(self, name: str, mapping: dict, namespace: str | None = None) -> None:
        if callable(mapping):
            raise TypeError("formats are tables, not functions")
        character = name.strip().startswith("$") if namespace is None else namespace in ("character", "char", "$")
        self.formats[self.key(name, character)] = dict(mapping)

    def register_informat(self, name: str, mapping: dict, kind: str | None = None) -> None:
        if callable(mapping):
            raise TypeError("informats are tables, not functions")
        character = name.strip().startswith("$") if kind is None else kind in ("character", "char", "$")
        self.informats[self.key(name, character)] = {str(k): float(v) for k, v in mapping.items()}


def _table(mapping: dict, key: Column) -> Column:
    if not mapping:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), key)


def _grouped(x: Column, decimals: int, commas: bool) -> Column:
    out = F.format_number(x, decimals)
    return out if commas else F.replace(out, F.lit(","), F.lit(""))


def _date(v: Value) -> Column:
    if v.type == "str":
        return F.to_date(v.col)
    if v.type in ("date", "ts", "null"):
        return v.col.cast("date")
    raise refuse("a date format needs a date")


def put(v: Value, form: str, catalog: Catalog) -> Value:
    name = form.strip().lower()
    table = catalog.formats.get(name.rstrip("."))
    if table is not None:
        if name.startswith("$"):
            hit = _table({str(k): str(x) for k, x in table.items()}, V.text(v))
        else:
            hit = _table({float(k): str(x) for k, x in table.items()}, V.number(v))
        return Value(F.coalesce(hit, V.text(v)), "str")
    if "." not in name:
        raise refuse(f"unsupported format: {form}")
    m = re.fullmatch(r"(\d+)\.(\d*)\.?", name)
    if m:
        return Value(_grouped(V.number(v), int(m[2] or 0), False), "str")
    if re.fullmatch(r"best\d*\.", name):
        return Value(V.number_text(V.number(v)), "str")
    m = re.fullmatch(r"z(\d+)\.(\d*)", name)
    if m:
        x, width = V.number(v), int(m[1])
        digits = _grouped(F.abs(x), int(m[2] or 0), False)
        sign = F.when((x < 0) & digits.rlike("[1-9]"), "-").otherwise("")
        room = F.greatest(F.lit(width) - F.length(sign), F.length(digits))
        return Value(F.concat(sign, F.lpad(digits, room, "0")), "str")
    m = re.fullmatch(r"comma(\d+)\.(\d*)", name)
    if m:
        return Value(_grouped(V.number(v), int(m[2] or 0), True), "str")
    if name.rstrip(".") in DATE_PATTERNS:
        return Value(F.date_format(_date(v), DATE_PATTERNS[name.rstrip(".")]), "str")
    if name == "e8601dt.":
        return Value(F.date_format(v.col.cast("timestamp"), TIME_PATTERN), "str")
    if name == "time.":
        return Value(F.date_format(_clock(v), "HH:mm:ss"), "str")
    raise refuse(f"unsupported format: {form}")


def _clock(v: Value) -> Column:
    """Time of day as a timestamp; times, and text ``HH:MM[:SS]``, on an arbitrary day."""
    if v.type == "time":
        v = Value(F.substring(v.col.cast("string"), 1, 8), "str")
    if v.type == "str":
        full = F.when(v.col.rlike(r"^\d{1,2}:\d{2}$"), F.concat(v.col, F.lit(":00"))).otherwise(v.col)
        return F.to_timestamp(F.concat(F.lit("1970-01-01 "), F.lpad(full, 8, "0")), "yyyy-MM-dd HH:mm:ss")
    if v.type in ("ts", "date", "null"):
        return v.col.cast("timestamp")
    raise refuse("a time of day is needed")


def read(v: Value, form: str, catalog: Catalog) -> Value:
    name = form.strip().lower()
    table = catalog.informats.get(name.rstrip("."))
    s = V.text(v)
    if table is not None:
        return Value(_table(table, s).cast("double"), "num")
    given = F.when(V.strip(s) != "", V.strip(s))
    if re.fullmatch(r"best\d*\.|\d+\.\d*\.?", name):
        return Value(V.number(Value(given, "str")), "num")
    if name.rstrip(".") == "yymmdd6":
        return Value(F.to_date(F.concat(F.lit("20"), given), "yyyyMMdd"), "date")
    if name.rstrip(".") in DATE_PATTERNS:
        return Value(F.to_date(given, DATE_PATTERNS[name.rstrip(".")]), "date")
    if name == "e8601dt.":
        return Value(F.to_timestamp(given, TIME_PATTERN), "ts")
    if name == "time.":
        return Value(F.date_format(_clock(Value(given, "str")), "HH:mm:ss"), "str")
    raise refuse(f"unsupported informat: {form}")


def hour(v: Value) -> Value:
    t = _clock(v)
    return Value(F.hour(t) + F.minute(t) / F.lit(60.0) + F.second(t) / F.lit(3600.0), "num")
