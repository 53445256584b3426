"""Source trees as DataFrames: reading, parsing, searching, rewriting.

Files are rows (path, text). Parsing runs per file in mapInArrow, one pass for
each relation asked for; everything after it is joins and filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PatternError, collapse
from .lexer import TRIVIA, Token, byte_offsets
from .parser import Node, Tree, parse
from .pattern import Condition, Let, Match, Pattern, Template, outermost, splice

NODES = "path string, node_id int, parent_id int, kind string, start int, end int, depth int, ordinal int"
TOKENS = "path string, token_id int, kind string, start int, end int, is_trivia boolean, text string"
ERRORS = "path string, start int, message string"
HITS = "path string, line int, col int, start int, end int, text string, binds map<string,string>"
# Folders that never hold source.
PRUNED = ("node_modules", "target", "dist", "build")


def file_class(path: Column) -> Column:
    """apex, object, field, page or labels by a path's ending; null for the rest."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.(cls|trigger)$"), "apex").when(low.endswith(".object-meta.xml"), "object").when(low.endswith(".field-meta.xml"), "field").when(low.endswith(".page"), "page").when(low.endswith(".labels-meta.xml"), "labels")


def read_files(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(path, file_class, text) of the relevant files below root; hidden and
    pruned folders are left out."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    raw = reader.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = F.col("path").rlike(r"/(?:\.[^/]+|" + "|".join(PRUNED) + ")/")
    return raw.select("path", file_class(F.col("path")).alias("file_class"), F.decode("content", "UTF-8").alias("text")).where(F.col("file_class").isNotNull() & ~hidden)


def under(path: Column, filters: list[str]) -> Column:
    """A file is itself; a folder is everything below it; none is everything."""
    out = F.lit(not filters)
    for f in filters:
        out = out | (path == f) | path.startswith(f.rstrip("/") + "/")
    return out


def overlay(disk: DataFrame, edited: DataFrame) -> DataFrame:
    """Texts of edited (path, text) over those of disk."""
    e = edited.select("path", F.col("text").alias("__t"))
    return disk.join(e, "path", "left").withColumn("text", F.coalesce("__t", "text")).drop("__t")


def is_trigger(path: str) -> bool:
    return path.lower().endswith(".trigger")


class Lines:
    """Bytes, lines and columns of character offsets."""

    def __init__(self, text: str):
        self.bytes = byte_offsets(text)
        self.starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def byte(self, at: int) -> int:
        return at if self.bytes is None or at < 0 else self.bytes[at]

    def line_col(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        k = bisect_right(self.starts, at) - 1
        return k + 1, self.byte(at) - self.byte(self.starts[k]) + 1

    def utf16(self, text: str, at: int) -> tuple[int, int]:
        """0-based line and UTF-16 column, as editors count."""
        line, _ = self.line_col(at)
        return line - 1, len(text[self.starts[line - 1]: at].encode("utf-16-le")) // 2


    def offset(self, text: str, line: int, col: int, utf16: bool = True) -> int | None:
        """Character offset of a 0-based line and column; past a line's end is
        its end, past the last line is None."""
        if line >= len(self.starts):
            return None
        at = self.starts[line]
        end = self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(text)
        left = col
        while at < end and left > 0:
            left -= (2 if ord(text[at]) > 0xFFFF else 1) if utf16 else len(text[at].encode("utf-8"))
            at += left >= 0
        return at


def negotiated(offered: list[str] | None) -> str:
    """The encoding of columns to use: the first offered one that is known, else UTF-16."""
    return next((e for e in offered or [] if e in ("utf-8", "utf-16", "utf-32")), "utf-16")


_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map": pa.map_(pa.string(), pa.string())}
#: Rows, or characters of text, after which a batch goes to Spark.
BATCH_ROWS, BATCH_CHARS = 20_000, 4_000_000


def bounded(batches: Iterator[pa.RecordBatch], f: Callable[[str, str], object], rows_of: Callable[[object], int]) -> Iterator[list[tuple]]:
    """Lists of (path, what f gives for a file): of so few files that their rows take
    little memory, whatever number of files comes at once."""
    import sys

    sys.setrecursionlimit(20_000)
    for b in batches:
        got, rows, chars = [], 0, 0
        for p, t in zip(b.column(0), b.column(1), strict=True):
            path, text = p.as_py(), t.as_py() or ""
            got.append((path, f(path, text)))
            rows += rows_of(got[-1][1])
            chars += len(text)
            if rows > BATCH_ROWS or chars > BATCH_CHARS:
                yield got
                got, rows, chars = [], 0, 0
        if got:
            yield got


def per_file(files: DataFrame, schema: str, f: Callable[[str, str], list[tuple]]) -> DataFrame:
    """The rows that f gives for each (path, text)."""
    cols = [c.strip().split(" ") for c in schema.replace("map<string,string>", "map").split(",")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x if x is None else list(x.items()) for x in v] if k == "map" else v, _KINDS[k]) for v, (_, k) in zip(zip(*rows), cols, strict=True)], names=[c for c, _ in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in bounded(batches, f, len):
            if rows := [r for _, rs in got for r in rs]:
                yield batch(rows)

    return files.select("path", "text").mapInArrow(run, schema)


def nodes(files: DataFrame) -> DataFrame:
    """Syntax nodes with byte ranges, parents and depths, in document order."""

    def rows(path: str, text: str) -> list[tuple]:
        tree, lines, out = parse(text, is_trigger(path)), Lines(text), []
        stack = [(tree.root, -1, 0, 0)]
        while stack:
            n, parent, depth, ordinal = stack.pop()
            nid = len(out)
            out.append((path, nid, parent, n.kind, lines.byte(n.start), lines.byte(n.end), depth, ordinal))
            kids = [(c, k) for k, c in enumerate(n.children) if isinstance(c, Node)]
            stack += [(c, nid, depth + 1, k) for c, k in reversed(kids)]
        return out

    return per_file(files, NODES, rows)


def token_rows(files: DataFrame) -> DataFrame:
    """All tokens; their texts in order give the file back byte for byte."""

    def rows(path: str, text: str) -> list[tuple]:
        lines = Lines(text)
        return [(path, i, t.kind, lines.byte(t.start), lines.byte(t.end), t.kind in TRIVIA, t.text) for i, t in enumerate(parse(text, is_trigger(path)).tokens)]

    return per_file(files, TOKENS, rows)


def parse_errors(files: DataFrame) -> DataFrame:
    def rows(path: str, text: str) -> list[tuple]:
        lines = Lines(text)
        return [(path, lines.byte(e.start), e.message) for e in parse(text, is_trigger(path)).errors]

    return per_file(files, ERRORS, rows)


def render(tokens: DataFrame) -> DataFrame:
    """(path, text) from token rows."""
    g = tokens.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("token_id", "text"))).alias("t"))
    return g.select("path", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def query_kind(files: DataFrame) -> DataFrame:
    """Inventory of queries in the source: inline ones and calls that take one as text."""
    return search(files, "kind:SoqlExpr").withColumn("form", F.lit("inline")).unionByName(
        search(files, "kind:SoslExpr").withColumn("form", F.lit("search"))
    ).unionByName(search(files, "Database.$m(...)", ands=["$m ~ {query,countQuery,getQueryLocator,queryWithBinds,countQueryWithBinds,getQueryLocatorWithBinds}"]).withColumn("form", F.lit("dynamic")))


# -- structural search -------------------------------------------------------
class Search:
    """A compiled search; raises PatternError for what cannot be compiled."""

    def __init__(self, pattern: str, ands: list[str] | None = None, nots: list[str] | None = None, lets: list[str] | None = None):
        self.pattern = Pattern(pattern)
        self.bound = set(self.pattern.names) | {str(i + 1) for i in range(len(self.pattern.groups))}
        self.lets: list[Let] = []
        for spec in lets or []:
            new = Let(spec, self.bound)
            old = next((x for x in self.lets if x.name == new.name), None)
            if old:
                old.merge(new)
            else:
                self.lets.append(new)
                self.bound.add(new.name)
        self.ands = [Condition(c, self.bound) for c in ands or []]
        self.nots = [Condition(c, self.bound) for c in nots or []]

    def matches(self, path: str, text: str) -> tuple[Tree, list[Match]]:
        tree = parse(text, is_trigger(path))
        types = None
        out = []
        for m in self.pattern.find(tree):
            for let in self.lets:
                m.binds = let.eval(tree, m.binds)
            if types is None and any(c.op == ":" for c in (*self.ands, *self.nots)):
                types = local_types(tree)
            type_of = (lambda b: types(b)) if types else (lambda b: None)
            if all(c.holds(m, tree, type_of) for c in self.ands) and not any(c.holds(m, tree, type_of) for c in self.nots):
                out.append(m)
        return tree, out


def local_types(tree: Tree):
    """A function from a captured span to the type that the file itself gives it:
    that of a declaration of the name, a literal, a cast or a constructor."""
    declared: dict[str, str] = {}
    for n in tree.root.walk():
        if n.kind in ("LocalVarDeclStmt", "FieldDecl", "ForEachStmt", "FormalParam", "CatchClause", "PropertyDecl", "ForInit"):
            ty = n.child("Type")
            if ty is None:
                continue
            for d in n.children:
                name = d if isinstance(d, Node) and d.kind == "DeclName" else d.child("DeclName") if isinstance(d, Node) and d.kind == "VarDeclarator" else None
                if name is not None:
                    declared[name.word().lower()] = "".join(t.text if t.text != "," else ", " for t in ty.tokens())
    kinds = {"StringLiteral": "String", "MultilineStringLiteral": "String", "IntegerLiteral": "Integer", "LongLiteral": "Long", "NumberLiteral": "Decimal", "DateLiteral": "Date", "DateTimeLiteral": "Datetime"}

    def of(span) -> str | None:
        text = span.text.strip()
        if text.lower() in declared:
            return declared[text.lower()]
        from .parser import parse_fragment

        e = parse_fragment(text, "Expression")
        if e is None:
            return None
        while e.kind == "ParenExpr":
            e = e.children[1]
        if e.kind == "LiteralExpr":
            t = e.children[0]
            return "Boolean" if t.low in ("true", "false") else kinds.get(t.kind)
        if e.kind in ("NewExpr", "CastExpr"):
            return "".join(t.text if t.text != "," else ", " for t in e.child("Type").tokens())
        if e.kind == "SoqlExpr":
            src = e.child("SoqlFromList")
            first = src.child("SoqlFieldName") if src else None
            return f"List<{first.word()}>" if first else None
        return None

    return of


def search(files: DataFrame, pattern: str, ands: list[str] | None = None, nots: list[str] | None = None, lets: list[str] | None = None) -> DataFrame:
    """Hits of a pattern: 1-based line and column (in bytes) of the place that is
    reported, the byte range and collapsed text of the match, and its captures."""
    compiled = Search(pattern, ands, nots, lets)

    def rows(path: str, text: str) -> list[tuple]:
        tree, found = compiled.matches(path, text)
        lines, out = Lines(text), []
        for m in found:
            at = m.binds["^"].start if "^" in m.binds else m.node.start
            out.append((path, *lines.line_col(at), lines.byte(m.node.start), lines.byte(m.node.end), text[m.node.start: m.node.end], {k: v.text for k, v in m.binds.items() if k != "^"}))
        return out

    return per_file(files, HITS, rows).withColumn("text", collapse(F.col("text")))


def ordered(hits: DataFrame) -> DataFrame:
    """Hits in the order of a report."""
    return hits.orderBy("path", "line", "col", F.col("end").desc())


REWRITES = "path string, new_text string, edits int, status string, reason string"


def rewrite(files: DataFrame, pattern: str, replace: list[str], ands: list[str] | None = None, nots: list[str] | None = None, lets: list[str] | None = None) -> DataFrame:
    """Files that a rewrite changes or refuses to: (path, new_text, edits, status,
    reason). One template replaces the whole match, `$N => template` a group.
    Nested matches collapse to the outermost; crossing ones, and texts that would
    gain parse errors, are refused and keep their text."""
    compiled = Search(pattern, ands, nots, lets)
    groups: dict[str, Template] = {}
    whole: Template | None = None
    for r in replace:
        head, sep, tail = r.partition("=>")
        if sep and head.strip().startswith("$") and head.strip()[1:].isdigit():
            n = head.strip()[1:]
            if n not in compiled.bound:
                raise PatternError(f"no group ${n}")
            groups[n] = Template(tail.removeprefix(" "), compiled.bound)
        else:
            whole = Template(r, compiled.bound)
    if (whole is None) == (not groups):
        raise PatternError("give one template for the match, or templates for groups")

    def rows(path: str, text: str) -> list[tuple]:
        tree, found = compiled.matches(path, text)
        edits = []
        for m in found:
            if isinstance(m.node, Token):
                continue
            if whole is not None:
                new = whole.render(m.binds)
                s, e = m.node.start, m.node.end
                if new == "":
                    s, e = whole_line(text, s, e)
                edits.append((s, e, new))
            else:
                edits += [(m.binds[n].start, m.binds[n].end, t.render(m.binds)) for n, t in groups.items() if n in m.binds]
        if not edits:
            return []
        try:
            edits = outermost(edits)
        except PatternError as e:
            return [(path, text, 0, "refused", str(e))]
        new = splice(text, edits, 0, len(text))
        gained = len(parse(new, is_trigger(path)).errors) - len(tree.errors)
        if gained > 0:
            return [(path, text, 0, "refused", f"{gained} more parse errors")]
        return [(path, new, len(edits), "changed", None)]

    return per_file(files, REWRITES, rows)


def whole_line(text: str, s: int, e: int) -> tuple[int, int]:
    """The line of a deletion that leaves nothing else on it."""
    lo = text.rfind("\n", 0, s) + 1
    hi = text.find("\n", e)
    hi = len(text) if hi < 0 else hi
    return (lo, min(hi + 1, len(text))) if not text[lo:s].strip() and not text[e:hi].strip() else (s, e)


def write_changes(rewrites: DataFrame) -> DataFrame:
    """(path, text) of the changed files, for a sink of the caller's choice."""
    return rewrites.where("status = 'changed'").select("path", F.col("new_text").alias("text"))
