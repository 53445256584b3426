"""Everything that one parse of a file tells, as one row with nested relations.

A file is parsed once however many relations are asked for: symbols, uses, parse
errors, unreachable statements, values and arguments of known type.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import Lines, bounded, is_trigger
from .parser import Node, parse
from .types import SCALARS, compatible, literal_type

RELATIONS = {
    "symbols": "local int, kind string, name string, container int, type_name string, type_args string, params string, arity int, visibility string, modifiers string, annotations string, supers string, start int, end int, name_start int, name_end int, has_body boolean, declarators int, decl_start int, decl_end int, type int, top int",
    "uses": "ref int, kind string, name string, receiver string, arity int, start int, end int, within int, local int, in_loop boolean, recv_ref int, args string, type int, top int",
    "errors": "start int, message string",
    "unreachable": "start int, end int",
    "mismatches": "start int, end int, message string",
    "args": "at int, k int, start int, end int, got string",
}
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in ddl.split(",")]


def terminates(n: Node) -> bool:
    """Whether control never leaves a statement at its end."""
    k = n.kind
    if k in ("ReturnStmt", "ThrowStmt", "BreakStmt", "ContinueStmt"):
        return True
    kids = list(n.nodes())
    if k == "Block":
        return any(terminates(c) for c in kids)
    if k == "IfStmt":
        return len(kids) == 3 and terminates(kids[1]) and terminates(kids[2])
    if k == "SwitchStmt":
        whens = [c for c in kids if c.kind == "WhenClause"]
        return any(c.child("WhenValue") is None for c in whens) and all(terminates(c.child("Block")) for c in whens)
    if k == "TryStmt":
        last = n.child("FinallyClause")
        return last is not None and terminates(last.child("Block"))
    return k == "DoWhileStmt" and terminates(kids[0])


def known_type(n: Node) -> str | None:
    """The type that an expression's own text tells."""
    while n.kind == "ParenExpr":
        n = n.children[1]
    if n.kind == "LiteralExpr":
        return literal_type(n.children[0].kind, n.children[0].text)
    return "".join(t.text for t in n.child("Type").tokens()) if n.kind in ("CastExpr", "NewExpr") and n.child("Type") else None


def unreachable(every: list[Node], lines: Lines) -> list[tuple]:
    out = []
    for b in every:
        if b.kind == "Block":
            over = False
            for c in b.nodes():
                if over:
                    out.append((lines.byte(c.start), lines.byte(c.end)))
                    break
                over = terminates(c)
    return out


def mismatches(every: list[Node], lines: Lines) -> list[tuple]:
    """Initialisers and returned values that cannot become the declared type."""
    out = []

    def test(want: str, value: Node) -> None:
        got = known_type(value)
        if got and compatible(want, got) is False:
            out.append((lines.byte(value.start), lines.byte(value.end), f"{got} cannot become {want}"))

    for n in every:
        if n.kind not in ("LocalVarDeclStmt", "FieldDecl", "MethodDecl"):
            continue
        want = "".join(t.text for t in n.child("Type").tokens()) if n.child("Type") else ""
        if n.kind in ("LocalVarDeclStmt", "FieldDecl") and want:
            for d in n.nodes():
                if d.kind == "VarDeclarator" and len(d.children) > 2:
                    test(want, d.children[2])
        elif n.kind == "MethodDecl" and n.child("Block"):
            for r in n.child("Block").walk():
                if r.kind == "ReturnStmt" and len(r.children) > 2:
                    test(want, r.children[1])
    return out


def arguments(every: list[Node], lines: Lines) -> list[tuple]:
    """Arguments of scalar type: the place of the call's name, their number and type."""
    out = []
    for n in every:
        lst = n.child("ArgList") if n.kind in ("CallExpr", "MethodCallExpr", "NewExpr") else None
        if lst is None:
            continue
        name = n.children[0] if n.kind == "CallExpr" else n.child("Type") if n.kind == "NewExpr" else [c for c in n.nodes() if c.kind == "DeclName"][-1]
        for k, a in enumerate(lst.nodes()):
            got = known_type(a)
            if got and got.lower() in SCALARS:
                out.append((lines.byte(name.start), k, lines.byte(a.start), lines.byte(a.end), got))
    return out


def of_file(path: str, text: str, only: tuple[str, ...] = tuple(RELATIONS)) -> dict[str, list[tuple]]:
    """The rows of the relations that are asked for."""
    from .bind import Collector

    tree = parse(text, is_trigger(path))
    c = Collector(path, tree, "uses" in only)
    lines, out = c.lines, {}
    if "symbols" in only or "uses" in only:
        c.run()
        own = c.owners()
        out |= {"symbols": [(*s[1:], *o) for s, o in zip(c.symbols, own, strict=True)], "uses": [(*r[1:], *(own[r[8]] if r[8] >= 0 else (None, None))) for r in c.refs]}
    out["errors"] = [(lines.byte(e.start), e.message) for e in tree.errors]
    if {"unreachable", "mismatches", "args"} & set(only):
        every = list(tree.root.walk())
        out |= {"unreachable": unreachable(every, lines), "mismatches": mismatches(every, lines), "args": arguments(every, lines)}
    return {name: out[name] for name in only}


def facts(files: DataFrame, only: tuple[str, ...] = tuple(RELATIONS)) -> DataFrame:
    """One row per file: its path and an array for each relation that is asked for."""
    fields = {name: columns(RELATIONS[name]) for name in only}
    schema = "path string, " + ", ".join(f"{name} array<struct<{', '.join(f'{c}:{k}' for c, k in cols)}>>" for name, cols in fields.items())

    def batch(paths: list, got: list[dict]) -> pa.RecordBatch:
        out = [pa.array(paths, pa.string())]
        for name, cols in fields.items():
            ends = [0, *accumulate(len(g[name]) for g in got)]
            flat = list(zip(*(r for g in got for r in g[name]))) or [()] * len(cols)
            rows = pa.StructArray.from_arrays([pa.array(v, _KINDS[k]) for v, (_, k) in zip(flat, cols, strict=True)], [c for c, _ in cols])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows))
        return pa.RecordBatch.from_arrays(out, names=["path", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in bounded(batches, lambda path, text: of_file(path, text, only), lambda g: sum(map(len, g.values()))):
            yield batch([path for path, _ in got], [g for _, g in got])

    return files.select("path", "text").mapInArrow(run, schema)


def relation(rows: DataFrame, name: str) -> DataFrame:
    """One relation of facts rows: path and the relation's columns."""
    return rows.select("path", F.explode(name).alias("__r")).select("path", "__r.*")
