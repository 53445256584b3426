"""Syntax trees of object queries (SOQL) and object searches (SOSL)."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that cannot be read or compiled."""


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Literal:
    kind: str  # null, boolean, string, number, date, datetime, time, currency
    value: object


@dataclass(frozen=True)
class DateFormula:
    name: str
    n: int | None = None


@dataclass(frozen=True)
class Bind:
    name: str


@dataclass(frozen=True)
class Values:
    items: tuple


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Geo:
    lat: object
    lon: object


@dataclass
class Item:
    expr: object  # Path, Call, Typeof, Query or Fields
    alias: str | None = None


@dataclass(frozen=True)
class Fields:
    which: str  # all, standard, custom


@dataclass(frozen=True)
class Typeof:
    path: Path
    whens: tuple  # ((type, (Path, ...)), ...)
    otherwise: tuple = ()


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False
    nulls: str | None = None  # first, last


@dataclass
class Query:
    items: list[Item]
    source: str
    alias: str | None = None
    more_sources: list[tuple[str, str | None]] = field(default_factory=list)
    scope: str | None = None
    where: object = None
    with_: object = None  # a condition, a mode string, or category tuples
    group_kind: str = ""  # "", plain, rollup, cube
    groups: list = field(default_factory=list)
    having: object = None
    order: list[Order] = field(default_factory=list)
    limit: object = None
    offset: object = None
    all_rows: bool = False
    for_: list[str] = field(default_factory=list)
    update: list[str] = field(default_factory=list)


@dataclass
class Returning:
    source: str
    items: list[Item] = field(default_factory=list)
    where: object = None
    listview: str | None = None
    order: list[Order] = field(default_factory=list)
    limit: object = None
    offset: object = None


@dataclass
class Search:
    term: object  # str or Bind
    fields: str = "all"
    returning: list[Returning] = field(default_factory=list)
    with_: dict[str, object] = field(default_factory=dict)
    limit: object = None
    update: list[str] = field(default_factory=list)
