"""Diagnostics: coded entries with the stage they belong to, the place in the program, and their rendering as text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STAGES = ("split blocks", "macro hook", "parse", "validate", "resolve inputs", "pre-processing inputs", "pre-evaluations", "execute", "resolve outputs")


@dataclass(frozen=True)
class Span:
    """A piece of the program: offsets, and line and column of its begin and end, from 1."""

    start: int
    end: int
    line: int
    column: int
    end_line: int
    end_column: int

    @staticmethod
    def of(source: str, start: int, end: int) -> Span:
        place = lambda i: (source.count("\n", 0, i) + 1, i - source.rfind("\n", 0, i))
        return Span(start, end, *place(start), *place(end))


@dataclass(frozen=True)
class Label:
    span: Span
    message: str = ""
    kind: str = "primary"


@dataclass(frozen=True)
class Notice:
    """A rule of the language that the program relies on and that may surprise."""

    id: str
    category: str
    summary: str


MISSING_NOTICE = Notice("COMPAT_MISSING_VALUE_SEMANTICS", "missing-values", "The literal . is a missing value (null).")
EMPTY_NOTICE = Notice("COMPAT_EMPTY_STRING_SEMANTICS", "missing-values", "An empty string is not null, but missing() and cmiss() count both.")


@dataclass(frozen=True)
class LogEntry:
    level: str
    code: str
    stage: str
    message: str
    statement: str = ""
    span: Span | None = None
    labels: tuple[Label, ...] = ()
    notes: tuple[str, ...] = ()
    source: str | None = field(default=None, repr=False)

    def located(self, source: str) -> LogEntry:
        """With the place of its statement in the program, where that is found."""
        at = source.find(self.statement) if self.statement else -1
        if at < 0:
            return replace(self, source=source)
        span = Span.of(source, at, at + len(self.statement))
        return replace(self, span=span, labels=(Label(span, self.message),), source=source)

    def __str__(self) -> str:
        out = [f"{self.level.upper()} [{self.code}] ({self.stage}) {self.message}"]
        for label in self.labels if self.source is not None else ():
            lines = self.source.split("\n")
            out.append(f"  at {label.span.line}:{label.span.column}")
            for n in range(label.span.line, label.span.end_line + 1):
                text = lines[n - 1]
                begin = label.span.column - 1 if n == label.span.line else len(text) - len(text.lstrip())
                end = label.span.end_column - 1 if n == label.span.end_line else len(text)
                out += [f"{n:>5} | {text}", f"      | {' ' * begin}{'^' * max(1, end - begin)}"]
        if not self.labels and self.statement:
            out.append(f"  in: {self.statement}")
        return "\n".join([*out, *(f"  note: {x}" for x in self.notes)])


class StepError(Exception):
    """A step can't run; nothing of it is published."""

    def __init__(self, code: str, message: str, stage: str = "validate", statement: str = ""):
        super().__init__(f"{code}: {message}")
        self.entry = LogEntry("error", code, stage, message, statement.strip())


@dataclass
class SubmitResult:
    success: bool
    datasets: dict = field(default_factory=dict)
    log: list[LogEntry] = field(default_factory=list)
    elapsed_seq: list[tuple[str, float]] = field(default_factory=list)
    notices: list[Notice] = field(default_factory=list)
    display_result: bool = field(default=True, repr=False)

    def __bool__(self) -> bool:
        return self.success

    def __repr__(self) -> str:
        return f"SubmitResult(success={self.success}, datasets={sorted(self.datasets)}, log={len(self.log)} entries)" if self.display_result else ""

    def render(self) -> str:
        return "\n".join(map(str, self.log))

    def format_log(self) -> str:
        seconds = self.elapsed_seq[-1][1] if self.elapsed_seq else 0.0
        head = [f"success: {self.success}", f"{seconds:.2f} seconds elapsed"]
        return "\n".join([*head, self.render() or "(no log entries)"])

    def print_log(self) -> None:
        print(self.format_log())
