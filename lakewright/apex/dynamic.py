"""Queries that are built as text: where they are run and what they bind."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .corpus import Lines, is_trigger, per_file
from .lexer import Token
from .parser import Node, parse

# Methods of Database that take a query's text.
ENTRY = set("query countquery getquerylocator querywithbinds countquerywithbinds getquerylocatorwithbinds".split())
_BIND = re.compile(r":\s*([A-Za-z_]\w*)")
DEPTH = 8


def looks_like_query(text: str) -> bool:
    return "select" in text.lower()


def bind_names(text: str) -> list[tuple[str, int]]:
    """(name, offset) of the :name binds of a query's text."""
    return [(m[1], m.start(1)) for m in _BIND.finditer(text)]


def literals(e: Node, body: Node, depth: int = 0) -> list[Token]:
    """String tokens that an expression is made of: through +, parentheses,
    choices, and the last assignment or declaration of a local before it."""
    if depth > DEPTH:
        return []
    if e.kind == "LiteralExpr":
        return [e.children[0]] if e.children[0].kind.endswith("StringLiteral") else []
    if e.kind in ("ParenExpr", "TernaryExpr") or e.kind == "BinExpr" and any(isinstance(c, Token) and c.text == "+" for c in e.children):
        return [t for c in e.nodes() for t in literals(c, body, depth + 1)]
    if e.kind == "NameExpr":
        name, last = e.word().lower(), None
        for n in body.walk():
            if not n.children or n.start >= e.start:
                continue
            if n.kind == "VarDeclarator" and n.child("DeclName").word().lower() == name and len(n.children) > 2:
                last = n.children[2]
            elif n.kind == "BinExpr" and isinstance(n.children[1], Token) and n.children[1].text in ("=", "+=") and n.children[0].word().lower() == name:
                last = n.children[2]
        return literals(last, body, depth + 1) if isinstance(last, Node) else []
    return []


def dynamic_queries(files: DataFrame) -> DataFrame:
    """(path, line, col, method, texts, binds) of calls that run a query's text."""

    def rows(path: str, text: str) -> list[tuple]:
        tree, lines, out = parse(text, is_trigger(path)), Lines(text), []
        for n in tree.root.walk():
            if n.kind != "MethodCallExpr" or n.children[0].word().lower() != "database":
                continue
            name = next((c for c in list(n.nodes())[1:] if c.kind == "DeclName"), None)
            args = n.child("ArgList")
            first = next(args.nodes(), None) if args else None
            if name is None or name.word().lower() not in ENTRY or first is None:
                continue
            toks = literals(first, tree.root)
            binds = sorted({b for t in toks for b, _ in bind_names(t.text)})
            out.append((path, *lines.line_col(n.start), name.word(), " ".join(t.text for t in toks), ",".join(binds)))
        return out

    return per_file(files, "path string, line int, col int, method string, texts string, binds string", rows)
