"""Object searches (SOSL): one DataFrame for each object that is returned."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import Catalogue
from .compiler import Compiler, Semantics
from .soql_ast import Bind, Call, Item, Path, Query, QueryError, Returning
from .soql_parser import parse_search


def term_pattern(word: str) -> str:
    """A pattern of a search word or phrase that takes whole words: * is any run of
    word characters, ? one of them, and any other sign stands between words."""
    parts = [re.escape(p).replace(r"\*", r"[\p{L}\p{N}_]*").replace(r"\?", r"[\p{L}\p{N}_]") for p in re.findall(r"[\w*?]+", word)]
    if not parts:
        raise QueryError(f"{word!r} holds no word")
    return r"(?i)(?:^|[^\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]+".join(parts) + r"(?:$|[^\p{L}\p{N}_])"


def terms(text: str) -> tuple:
    """The search as a tree: ('or', parts), ('and', parts), ('not', part) or
    ('word', text). NOT binds first, then AND, also unwritten, then OR."""
    marks = [("word", m[1]) if m[1] is not None else (m[2], m[2]) if m[2] in ("(", ")", "AND", "OR", "NOT") else ("word", m[2]) for m in re.finditer(r'"([^"]*)"|([()]|[^\s()"]+)', text)]
    at = 0

    def peek() -> str | None:
        return marks[at][0] if at < len(marks) else None

    def either() -> tuple:
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both() -> tuple:
        nonlocal at
        parts = [one()]
        while peek() not in (None, ")", "OR"):
            at += peek() == "AND"
            parts.append(one())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def one() -> tuple:
        nonlocal at
        kind = peek()
        if kind is None or kind in (")", "AND", "OR"):
            raise QueryError("FIND needs a word" if kind is None else f"FIND needs a word before {kind}")
        at += 1
        if kind == "NOT":
            return "not", one()
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise QueryError("FIND lacks a closing parenthesis")
            at += 1
            return inner
        return "word", marks[at - 1][1]

    tree = either()
    if at < len(marks):
        raise QueryError("FIND has a closing parenthesis too many")
    return tree


def words(tree: tuple, wanted: bool = True) -> list[str]:
    """The words that a search asks for, not those that it rules out."""
    if tree[0] == "word":
        return [tree[1]] if wanted else []
    return words(tree[1], not wanted) if tree[0] == "not" else [w for t in tree[1] for w in words(t, wanted)]


def matches(columns: list[Column], text: str) -> Column:
    def holds(tree: tuple) -> Column:
        kind, what = tree
        if kind == "word":
            return reduce(lambda a, b: a | b, (F.coalesce(c.rlike(term_pattern(what)), F.lit(False)) for c in columns))
        if kind == "not":
            return ~holds(what)
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), (holds(t) for t in what))

    return holds(terms(text))


def sosl(cat: Catalogue, text: str, binds: dict | None = None, semantics: Semantics | None = None) -> dict[str, DataFrame]:
    """Rows by object, in the order of RETURNING; every searchable object if
    there is none. A row has the fields asked for, else the object's id. LIMIT after
    RETURNING holds for all objects together, the first ones first. WITH DATA CATEGORY
    and WITH DIVISION filter objects that have the field; others keep their rows."""
    s = parse_search(text)
    comp = Compiler(cat, semantics, binds)
    word = comp.bind(s.term.name) if isinstance(s.term, Bind) else s.term
    specs = s.returning or [Returning(e.name) for e in cat.entities.values() if e.search.get(s.fields)]
    out: dict[str, DataFrame] = {}
    most = None if s.limit is None else int(comp.bind(s.limit.name) if isinstance(s.limit, Bind) else s.limit.value)
    for k, spec in enumerate(specs):
        entity = cat.get(spec.source)
        if entity is None:
            raise QueryError(f"unknown object {spec.source!r}")
        fields = entity.search.get(s.fields) or (entity.search.get("all", ()) if s.fields == "all" else ())
        items = spec.items or [Item(Path((c,))) for c in entity.id_fields]
        q = Query(items, spec.source, where=spec.where, order=spec.order, limit=spec.limit, offset=spec.offset, scope=spec.listview)
        scope = comp.scope(q)
        cols = [F.col(f"`{scope.tag}__{c}`") for c in fields]
        selected = [(comp.expr(i.expr, scope), i.alias or (i.expr.parts[-1] if isinstance(i.expr, Path) else i.expr.name if isinstance(i.expr, Call) else "expr")) for i in items]
        orders = [comp.order(o, comp.expr(o.expr, scope)) for o in spec.order]
        comp.where(scope, spec.where)
        for group, how, names in s.with_.get("data_category", ()):
            if cat.field(scope.columns(entity), group):
                scope.df = scope.df.filter(comp.category(scope, group, how, names))
        if "division" in s.with_ and cat.field(scope.columns(entity), "division"):
            scope.df = scope.df.filter(scope.column(Path(("division",))) == comp.literal(s.with_["division"]))
        df = scope.df.filter(matches(cols, word) if cols else F.lit(False))
        if orders:
            df = df.orderBy(*orders)
        df = comp.sliced(q, df)
        extra = []
        if "snippet" in s.with_ and cols:
            extra.append(snippet(cols[0], word, s.with_["snippet"]).alias("snippet"))
        if "highlight" in s.with_ and cols:
            extra.append(highlight(cols[0], word).alias("highlight"))
        df = df.select(*(c.alias(n) for c, n in selected), *extra)
        if most is not None:
            df = df.limit(most)
            if k + 1 < len(specs):  # what is left for the objects after it
                most -= df.count()
        out[entity.name] = df
    return out


def _literal_words(text: str) -> str:
    return "|".join(re.escape(w).replace(r"\*", r"\w*").replace(r"\?", r"\w") for w in words(terms(text)))


def highlight(col: Column, text: str) -> Column:
    return F.regexp_replace(col, f"(?i)({_literal_words(text)})", "<mark>$1</mark>")


def snippet(col: Column, text: str, length) -> Column:
    n = int(length.value) if length is not None else 120
    at = F.regexp_instr(col, F.lit(f"(?i){_literal_words(text)}"))
    return F.substring(col, F.greatest(at - n // 2, F.lit(1)), F.lit(n))
