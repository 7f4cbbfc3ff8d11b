"""Syntax trees of programs."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- expressions


@dataclass(frozen=True)
class Literal:
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Index:
    array: str
    at: object


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    format: str | None = None  # second argument of put and input, as written


# ---- statements


@dataclass
class DatasetRef:
    name: str
    options: dict = field(default_factory=dict)  # in, keep, drop, where, rename, firstobs, obs, label


@dataclass
class Statement:
    kind: str
    text: str = ""
    data: dict = field(default_factory=dict)
    body: list[Statement] = field(default_factory=list)
    orelse: list[Statement] = field(default_factory=list)


@dataclass
class Block:
    targets: list[DatasetRef]
    statements: list[Statement]
    text: str = ""


def walk(statements: list[Statement]):
    for s in statements:
        yield s
        yield from walk(s.body)
        yield from walk(s.orelse)


def expressions(node):
    """The node and all expressions below it."""
    yield node
    for child in (getattr(node, k, None) for k in ("at", "arg", "left", "right")):
        if child is not None:
            yield from expressions(child)
    for child in getattr(node, "args", ()):
        yield from expressions(child)


def in_statement(s: Statement):
    for key in ("expr", "cond", "low", "high", "index"):
        if s.data.get(key) is not None:
            yield from expressions(s.data[key])
