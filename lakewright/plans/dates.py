"""Relative date formulas as half-open intervals of days."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from .soql_ast import DateFormula, QueryError


def add_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, monthrange(y, m + 1)[1]))


def start_of(unit: str, d: date, week_start: int, fiscal_start: int) -> date:
    """First day of d's unit. week_start: 0 is Monday; fiscal_start: a month."""
    if unit == "day":
        return d
    if unit == "week":
        return d - timedelta(days=(d.weekday() - week_start) % 7)
    shift = fiscal_start - 1 if unit.startswith("fiscal_") else 0
    s = add_months(date(d.year, d.month, 1), -shift)
    size = {"month": 1, "quarter": 3, "year": 12}[unit.removeprefix("fiscal_")]
    return add_months(date(s.year, (s.month - 1) // size * size + 1, 1), shift)


def step(unit: str, d: date, n: int) -> date:
    if unit in ("day", "week"):
        return d + timedelta(days=n * (7 if unit == "week" else 1))
    return add_months(d, n * {"month": 1, "quarter": 3, "year": 12}[unit.removeprefix("fiscal_")])


def interval(f: DateFormula, as_of: date, week_start: int = 6, fiscal_start: int = 1) -> tuple[date, date]:
    """First day, and day after the last."""
    name, n = f.name, f.n
    day = timedelta(days=1)
    fixed = {"yesterday": (-1, 0), "today": (0, 1), "tomorrow": (1, 2), "last_90_days": (-90, 1), "next_90_days": (1, 91)}
    if name in fixed:
        a, b = fixed[name]
        return as_of + a * day, as_of + b * day
    words = name.split("_")
    if n is None:
        unit, turn = "_".join(words[1:]), {"last": -1, "this": 0, "next": 1}[words[0]]
        start = step(unit, start_of(unit, as_of, week_start, fiscal_start), turn)
        return start, step(unit, start, 1)
    if words[-1] == "ago":
        unit = "_".join(words[1:-1]).removesuffix("s")
        start = step(unit, start_of(unit, as_of, week_start, fiscal_start), -n)
        return start, step(unit, start, 1)
    if words[0] not in ("last", "next"):
        raise QueryError(f"unknown date formula {name!r}")
    unit = "_".join(words[2:]).removesuffix("s")
    start = start_of(unit, as_of, week_start, fiscal_start)
    if words[0] == "next":
        return step(unit, start, 1), step(unit, start, n + 1)
    return (step(unit, start, -n), start + day) if unit == "day" else (step(unit, start, -n), start)
