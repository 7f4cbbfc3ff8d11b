"""``put``, ``input`` and ``hour`` on Python values, for the row loop; the columns' rules are in :mod:`rowloom.functions.formats`."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from .formats import DATE_PATTERNS, Catalog

_DATE = {"yyMMdd": "%y%m%d", "yyyyMMdd": "%Y%m%d", "yyyy-MM-dd": "%Y-%m-%d"}


def _fixed(x: float, decimals: int, commas: bool) -> str:
    return format(x, f"{',' if commas else ''}.{decimals}f")  # exact ties to even, on the binary value


def _day(v) -> dt.date | None:
    if v is None:
        return None
    if isinstance(v, str):
        return dt.date.fromisoformat(v[:10])
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    raise ValueError("a date format needs a date")


def _clock(v) -> dt.time | None:
    if v is None:
        return None
    if isinstance(v, str):
        return dt.time(*[int(x) for x in v.split(":")])
    if isinstance(v, dt.datetime):
        return v.time()
    if isinstance(v, dt.date):
        return dt.time()
    raise ValueError("a time of day is needed")


def put(v, form: str, catalog: Catalog, number, text, number_text) -> str | None:
    name = form.strip().lower()
    bare = name.rstrip(".")
    table = catalog.formats.get(bare)
    if table is not None:
        if name.startswith("$"):
            return {str(k): str(x) for k, x in table.items()}.get(text(v), text(v))
        return {float(k): str(x) for k, x in table.items()}.get(number(v), text(v))
    if "." not in name:
        raise ValueError(f"unsupported format: {form}")
    if m := re.fullmatch(r"(comma|z)?(\d+)\.(\d*)\.?", name):
        x = number(v)
        if x is None or m[1] != "z":
            return None if x is None else _fixed(x, int(m[3] or 0), m[1] == "comma")
        digits = _fixed(abs(x), int(m[3] or 0), False)
        sign = "-" if x < 0 and re.search("[1-9]", digits) else ""
        return sign + digits.rjust(int(m[2]) - len(sign), "0")
    if re.fullmatch(r"best\d*\.", name):
        x = number(v)
        return None if x is None else number_text(x)
    if bare in DATE_PATTERNS:
        d = _day(v)
        return None if d is None else d.strftime(_DATE[DATE_PATTERNS[bare]])
    if name == "e8601dt.":
        if isinstance(v, str):
            v = dt.datetime.fromisoformat(v)
        return None if v is None else dt.datetime.combine(_day(v), _clock(v)).strftime("%Y-%m-%dT%H:%M:%S")
    if name == "time.":
        t = _clock(v)
        return None if t is None else t.strftime("%H:%M:%S")
    raise ValueError(f"unsupported format: {form}")


def read(v, form: str, catalog: Catalog, number, text, zone: str):
    name = form.strip().lower()
    bare = name.rstrip(".")
    table = catalog.informats.get(bare)
    if table is not None:
        return table.get(text(v))
    given = text(v).strip()
    if not (re.fullmatch(r"best\d*\.|\d+\.\d*\.?", name) or bare in DATE_PATTERNS or name in ("e8601dt.", "time.")):
        raise ValueError(f"unsupported informat: {form}")
    if not given:
        return None
    if bare == "yymmdd6":
        return dt.datetime.strptime(f"20{given}", "%Y%m%d").date()
    if bare in DATE_PATTERNS:
        return dt.datetime.strptime(given, _DATE[DATE_PATTERNS[bare]]).date()
    if name == "e8601dt.":
        return dt.datetime.strptime(given, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=ZoneInfo(zone))
    if name == "time.":
        return _clock(given).strftime("%H:%M:%S")
    return number(given)


def hour(v) -> float | None:
    t = _clock(v)
    return None if t is None else t.hour + t.minute / 60.0 + t.second / 3600.0
