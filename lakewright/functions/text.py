"""Text functions as column expressions, and globs as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def quote(c: Column) -> Column:
    """Text that can stand inside a quoted literal on one line."""
    return F.regexp_replace(collapse(c), r"([\\'])", r"\\$1")


def identifier(c: Column) -> Column:
    """A name made of an expression's words: a.Id becomes aId. A leading digit
    gets a k before it; no word at all gives x."""
    words = F.filter(F.split(c, "[^A-Za-z0-9_]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))), "")
    return F.when(F.size(words) == 0, F.lit("x")).when(joined.rlike("^[0-9]"), F.concat(F.lit("k"), joined)).otherwise(joined)


class PatternError(ValueError):
    """A pattern, condition or template that cannot be compiled."""


def glob_parts(glob: str) -> list[tuple[str, str]]:
    """("re", regex) and ("ref", name) parts of a glob: * ? {a,b} and $NAME."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(("re", ".*"))
        elif ch == "?":
            out.append(("re", "."))
        elif ch == "{":
            end = glob.find("}", i)
            if end < 0:
                raise PatternError(f"a brace is not closed: {glob}")
            alts = glob[i + 1: end].split(",")
            out.append(("re", "(?:" + "|".join("".join(r for k, r in glob_parts(a) if k == "re") for a in alts) + ")"))
            i = end
        elif ch == "$" and (m := re.match(r"\$(\w+)", glob[i:])):
            out.append(("ref", m[1]))
            i += m.end() - 1
        else:
            out.append(("re", re.escape(ch)))
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """An anchored, case-insensitive regular expression; * crosses lines."""
    parts = glob_parts(glob)
    if any(k == "ref" for k, _ in parts):
        raise PatternError("this glob names another capture")
    return "(?is)^(?:" + "".join(r for _, r in parts) + ")$"


def glob_column(value: Column, glob: str, captures: dict[str, Column]) -> Column:
    """A glob against value in which $NAME stands for another column's text."""
    parts = []
    for kind, text in glob_parts(glob):
        if kind == "re":
            parts.append(F.lit(text))
        elif text in captures:
            parts.append(F.concat(F.lit("\\Q"), F.replace(captures[text], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        else:
            raise PatternError(f"no capture ${text}")
    return F.coalesce(F.rlike(value, F.concat(F.lit("(?is)^(?:"), *parts, F.lit(")$"))), F.lit(False))


def flagged_regex(src: str) -> str:
    """/body/flags as one regular expression; flags are i, x, s and m. Look-around
    and back-references are rejected, as they are not linear."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", src, re.DOTALL)
    if not m:
        raise PatternError(f"not a regular expression: {src}")
    body, flags = m[1], m[2]
    if set(flags) - set("ixsm"):
        raise PatternError(f"unknown flags {''.join(sorted(set(flags) - set('ixsm')))!r}")
    if re.search(r"(?<!\\)\(\?(?:[=!]|<[=!])|(?<!\\)\\[1-9]|(?<!\\)\\k<", body):
        raise PatternError("look-around and back-references are not supported")
    return (f"(?{flags})" if flags else "") + body
