"""Symbols, references and types of a source corpus, resolved by joins.

One pass per file gives declarations, and names in use with what the body's own
scopes say of them (a local, or the declared type of the receiver). Whatever
crosses files is joined: type names to types, members along the inheritance
closure, and query fields to a schema. Names compare without case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import closure, lookup
from ..storage import cut
from .corpus import Lines
from .facts import RELATIONS, facts, known_type, relation
from .lexer import Token
from .parser import Node, Tree
from .types import pick_overload

SYMBOLS, REFS = ("path string, " + RELATIONS[r] for r in ("symbols", "uses"))
TYPES = {"ClassDecl": "Class", "InterfaceDecl": "Interface", "EnumDecl": "Enum"}
OWNERS = {*TYPES.values(), "Trigger"}
LOOPS = {"ForStmt", "ForEachStmt", "WhileStmt", "DoWhileStmt"}


def type_text(n: Node | None) -> tuple[str | None, str | None]:
    """(name, arguments) of a type; arrays are lists."""
    if n is None:
        return None, None
    text = n.word()
    while text.endswith("[]"):
        text = f"List<{text[:-2]}>"
    head, _, args = text.partition("<")
    return head, args[:-1] if args else None


def modifiers(n: Node) -> tuple[str, list[str], list[str]]:
    words = [" ".join(t.low for t in c.tokens()) for c in n.nodes() if c.kind == "Modifier"]
    notes = [next(t for t in c.tokens() if t.kind == "Word").low for c in n.nodes() if c.kind == "Annotation"]
    vis = next((w for w in words if w in ("private", "protected", "public", "global")), "private")
    return vis, words, notes


def whole(parts: tuple[str | None, str | None]) -> str | None:
    return f"{parts[0]}<{parts[1]}>" if parts[0] and parts[1] else parts[0]


class Collector:
    """Declarations and uses of one file."""

    def __init__(self, path: str, tree: Tree, want_uses: bool = True):
        self.path, self.tree, self.lines, self.want_uses = path, tree, Lines(tree.text), want_uses
        self.symbols: list[list] = []
        self.refs: list[tuple] = []

    def add(self, kind: str, n: Node, name: Node | None, container: int, ty: Node | None = None, params: Node | None = None, supers: list[str] | None = None, vis: str | None = None, among: tuple[int, Node] | None = None) -> int:
        """among: how many declarators share the declaration, and this one."""
        v, words, notes = modifiers(n)
        tn, ta = type_text(ty)
        ps = [whole(type_text(p.child("Type"))) or "?" for p in params.nodes()] if params else []
        at = name or n
        many, own = among or (1, n)
        b = self.lines.byte
        self.symbols.append([self.path, len(self.symbols), kind, at.word() if name else "", container, tn, ta, ";".join(ps), len(ps), vis or v, " ".join(words), ",".join(notes), ",".join(supers or []), b(n.start), b(n.end), b(at.start), b(at.end), n.child("Block") is not None, many, b(own.start), b(own.end)])
        return len(self.symbols) - 1

    def run(self) -> None:
        for n in self.tree.root.nodes():
            if n.kind in TYPES:
                self.type_decl(n, -1)
            elif n.kind == "TriggerUnit":
                t = self.add("Trigger", n, n.child("DeclName"), -1, n.child("Type"))
                self.body(n.child("Block"), t, [{}])

    def type_decl(self, n: Node, container: int) -> None:
        supers = [type_text(t)[0] for lst in n.nodes() if lst.kind == "TypeRefList" for t in lst.nodes()]
        me = self.add(TYPES[n.kind], n, n.child("DeclName"), container, supers=supers)
        for lst in n.nodes():
            if lst.kind == "TypeRefList":
                for t in lst.nodes():
                    self.type_use(t, me)
        for c in n.nodes():
            if c.kind == "EnumConstantList":
                for name in c.nodes():
                    self.add("EnumConstant", name, name, me, vis=self.symbols[me][9])
            elif c.kind in ("ClassBody", "InterfaceBody"):
                for m in c.nodes():
                    self.member(m, me, c.kind == "InterfaceBody")

    def member(self, m: Node, me: int, interface: bool) -> None:
        if m.kind in TYPES:
            self.type_decl(m, me)
        elif m.kind in ("MethodDecl", "ConstructorDecl"):
            params = m.child("FormalParamList")
            vis = "public" if interface and not any(c.kind == "Modifier" for c in m.nodes()) else None
            k = self.add("Method" if m.kind == "MethodDecl" else "Constructor", m, m.child("DeclName"), me, m.child("Type"), params, vis=vis)
            scope: dict[str, tuple[int, str | None]] = {}
            self.type_use(m.child("Type"), k)
            for p in params.nodes():
                if p.child("DeclName"):
                    self.type_use(p.child("Type"), k)
                    scope[p.child("DeclName").word().lower()] = (self.add("Parameter", p, p.child("DeclName"), k, p.child("Type")), whole(type_text(p.child("Type"))))
            self.body(m.child("Block"), k, [scope])
        elif m.kind == "FieldDecl":
            ty = m.child("Type")
            many = sum(d.kind == "VarDeclarator" for d in m.nodes())
            for d in m.nodes():
                if d.kind == "VarDeclarator":
                    k = self.add("Field", m, d.child("DeclName"), me, ty, among=(many, d))
                    self.type_use(ty, k)
                    for c in d.nodes():
                        if c.kind != "DeclName":
                            self.expr(c, k, [{}], False)
        elif m.kind == "PropertyDecl":
            k = self.add("Property", m, m.child("DeclName"), me, m.child("Type"))
            self.type_use(m.child("Type"), k)
            for a in m.nodes():
                if a.kind == "PropertyAccessor" and a.child("Block"):
                    value = {"value": (-2, whole(type_text(m.child("Type"))))} if any(isinstance(t, Token) and t.low == "set" for t in a.children) else {}
                    self.body(a.child("Block"), k, [value])
        elif m.kind == "StaticInitializer":
            self.body(m.child("Block"), me, [{}])

    def owners(self) -> list[tuple[int | None, int]]:
        """For each symbol the type that it belongs to, and the outermost symbol."""
        out: list[tuple[int | None, int]] = []
        for s in self.symbols:
            ty, top = out[s[4]] if s[4] >= 0 else (None, s[1])
            out.append((s[1] if s[2] in OWNERS else ty, top))
        return out

    # -- bodies ------------------------------------------------------------
    def use(self, kind: str, name: str, receiver: str | None, arity: int, at, within: int, local: int = -1, loop: bool = False, recv: Node | None = None, args: str | None = None) -> None:
        b = self.lines.byte
        self.refs.append((self.path, len(self.refs), kind, name, receiver, arity, b(at.start), b(at.end), within, local, loop, self.name_place(recv), args))

    def name_place(self, e: Node | None) -> int:
        """The byte at which the name of a member receiver stands, -1 if it is none."""
        while e is not None and e.kind == "ParenExpr":
            e = e.children[1]
        if e is not None and e.kind == "NameExpr":
            return self.lines.byte(e.start)
        if e is None or e.kind not in ("FieldExpr", "MethodCallExpr", "CallExpr"):
            return -1
        if e.kind == "CallExpr":
            return self.lines.byte(e.children[0].start) if e.children[0].kind == "NameExpr" else -1
        return self.lines.byte((e.child("DeclName") if e.children[0].kind != "DeclName" else e.children[2]).start)

    def arg_types(self, args: Node | None, scopes: list[dict]) -> str | None:
        """Types of arguments as far as the file tells, ? for the others."""
        if args is None:
            return None

        def of(a: Node) -> str:
            got = known_type(a)
            if not got and a.kind == "NameExpr":
                local = self.local(a.word(), scopes)
                got = local[1] if local else None
            return got or "?"

        return ";".join(of(a) for a in args.nodes())

    def type_use(self, n: Node | None, within: int) -> None:
        if n is None or not self.want_uses:
            return
        for t in n.walk():
            if t.kind == "Type" and (name := type_text(t)[0]) not in (None, "void"):
                self.use("type", name, None, -1, t.children[0] if t.children else t, within)

    def body(self, n: Node | None, within: int, scopes: list[dict], loop: bool = False) -> None:
        if n is None:
            return
        if n.kind in ("Block",):
            scopes = [*scopes, {}]
            for c in n.nodes():
                self.body(c, within, scopes, loop)
        elif n.kind in ("LocalVarDeclStmt", "ForInit") and n.child("Type"):
            self.type_use(n.child("Type"), within)
            many = sum(d.kind == "VarDeclarator" for d in n.nodes())
            for d in n.nodes():
                if d.kind == "VarDeclarator":
                    for c in d.nodes():
                        if c.kind != "DeclName":
                            self.expr(c, within, scopes, loop)
                    self.declare("LocalVar", n, d.child("DeclName"), n.child("Type"), within, scopes, (many, d))
        elif n.kind == "ForEachStmt" and n.child("Type"):
            inner = [*scopes, {}]
            self.type_use(n.child("Type"), within)
            kids = list(n.nodes())
            name = n.child("DeclName")
            rest = [c for c in kids[kids.index(name) + 1:]]
            self.expr(rest[0], within, scopes, loop)
            self.declare("ForEachVar", n, name, n.child("Type"), within, inner)
            for c in rest[1:]:
                self.body(c, within, inner, True)
        elif n.kind in LOOPS:
            inner, kids = [*scopes, {}], list(n.nodes())
            for c in kids:
                is_body = c is kids[-1] if n.kind != "DoWhileStmt" else c is kids[0]
                self.body(c, within, inner, loop or is_body)
        elif n.kind == "CatchClause":
            inner = [*scopes, {}]
            if n.child("DeclName"):
                self.type_use(n.child("Type"), within)
                self.declare("CatchVar", n, n.child("DeclName"), n.child("Type"), within, inner)
            self.body(n.child("Block"), within, inner, loop)
        elif n.kind == "WhenClause":
            inner, v = [*scopes, {}], n.child("WhenValue")
            if v is not None and v.child("DeclName"):
                self.type_use(v.child("Type"), within)
                self.declare("SwitchBindingVar", v, v.child("DeclName"), v.child("Type"), within, inner)
            self.body(n.child("Block"), within, inner, loop)
        elif n.kind.endswith("Stmt") or n.kind in ("ForUpdate", "FinallyClause", "TryStmt"):
            if n.kind in ("InsertStmt", "UpdateStmt", "DeleteStmt", "UndeleteStmt", "UpsertStmt", "MergeStmt"):
                if self.want_uses:
                    self.use("dml", n.kind, None, -1, n, within, loop=loop)
            for c in n.nodes():
                self.body(c, within, scopes, loop)
        elif n.kind in ("AccessLevelClause", "QualifiedName", "ErrorNode"):
            return
        else:
            self.expr(n, within, scopes, loop)

    def declare(self, kind: str, n: Node, name: Node, ty: Node, within: int, scopes: list[dict], among: tuple[int, Node] | None = None) -> None:
        scopes[-1][name.word().lower()] = (self.add(kind, n, name, within, ty, among=among), whole(type_text(ty)))

    def local(self, name: str, scopes: list[dict]):
        return next((s[name.lower()] for s in reversed(scopes) if name.lower() in s), None)

    def receiver(self, e: Node, scopes: list[dict]) -> str | None:
        """Type name of an expression as far as the file tells: `this`, `super`,
        `:Name` for the type of a local, a bare name for a type or a member."""
        while e.kind == "ParenExpr":
            e = e.children[1]
        if e.kind in ("ThisExpr", "SuperExpr"):
            return "this" if e.kind == "ThisExpr" else "super"
        if e.kind == "NameExpr":
            got = self.local(e.word(), scopes)
            return (":" + got[1]) if got and got[1] else "?" if got else e.word()
        if e.kind in ("NewExpr", "CastExpr") and e.child("Type"):
            return ":" + (whole(type_text(e.child("Type"))) or "?")
        if e.kind == "LiteralExpr":
            return ":String" if e.children[0].kind.endswith("StringLiteral") else "?"
        if e.kind == "FieldExpr" and all(c.kind in ("NameExpr", "DeclName", "FieldExpr") for c in e.walk()) and not self.local(next(e.tokens()).text, scopes):
            return e.word()
        return "?"

    def expr(self, n: Node, within: int, scopes: list[dict], loop: bool) -> None:
        stack = [n] if self.want_uses else []
        while stack:
            e = stack.pop()
            if e.kind == "NameExpr":
                got = self.local(e.word(), scopes)
                self.use("name", e.word(), None, -1, e, within, got[0] if got else -1)
                continue
            if e.kind == "CallExpr" and e.children[0].kind == "NameExpr":
                self.use("method", e.children[0].word(), None, self.count(e.child("ArgList")), e.children[0], within, loop=loop, args=self.arg_types(e.child("ArgList"), scopes))
                stack += list(e.child("ArgList").nodes())
                continue
            if e.kind == "CallExpr" and e.children[0].kind in ("ThisExpr", "SuperExpr"):
                self.use("constructor", "", "this" if e.children[0].kind == "ThisExpr" else "super", self.count(e.child("ArgList")), e.children[0], within, args=self.arg_types(e.child("ArgList"), scopes))
                stack += list(e.child("ArgList").nodes())
                continue
            if e.kind in ("FieldExpr", "MethodCallExpr"):
                d = e.child("DeclName") if e.children[0].kind != "DeclName" else e.children[2]
                call = e.kind == "MethodCallExpr"
                self.use("method" if call else "field", d.word(), self.receiver(e.children[0], scopes), self.count(e.child("ArgList")) if call else -1, d, within, loop=loop, recv=e.children[0], args=self.arg_types(e.child("ArgList"), scopes) if call else None)
                stack.append(e.children[0])
                if call:
                    stack += list(e.child("ArgList").nodes())
                continue
            if e.kind == "NewExpr":
                self.type_use(e.child("Type"), within)
                if e.child("ArgList"):
                    self.use("new", type_text(e.child("Type"))[0], None, self.count(e.child("ArgList")), e.child("Type"), within, args=self.arg_types(e.child("ArgList"), scopes))
                    own = [a for a in e.child("ArgList").nodes()]
                    stack += [a.children[2] if a.kind == "BinExpr" and isinstance(a.children[1], Token) and a.children[1].text == "=" and a.children[0].kind == "NameExpr" else a for a in own]
                    stack += [c for c in e.nodes() if c.kind not in ("Type", "ArgList")]
                else:
                    stack += [c for c in e.nodes() if c.kind != "Type"]
                continue
            if e.kind in ("SoqlExpr", "SoqlSubQuery"):
                self.soql(e, within, scopes, loop, stack)
                continue
            if e.kind == "SoslExpr":
                self.use("sosl", "", None, -1, e, within, loop=loop)
            if e.kind == "Type":
                self.type_use(e, within)
                continue
            stack += list(e.nodes())

    @staticmethod
    def count(args: Node | None) -> int:
        return len(list(args.nodes())) if args else 0

    def soql(self, e: Node, within: int, scopes: list[dict], loop: bool, stack: list) -> None:
        src = e.child("SoqlFromList")
        first = src.child("SoqlFieldName") if src else None
        obj = first.word() if first else None
        self.use("soql", obj or "", None, -1, e, within, loop=loop)
        if obj:
            self.use("soql_object" if e.kind == "SoqlExpr" else "soql_child", obj, None, -1, first, within)
        todo = [c for c in e.nodes() if c.kind not in ("SoqlFromList", "SoqlForClause", "SoqlUsingScope", "SoqlUpdateList")]
        while todo:
            c = todo.pop()
            if c.kind == "SoqlBoundExpr":
                stack.append(c.children[1])
            elif c.kind == "SoqlSubQuery":
                stack.append(c)
            elif c.kind == "SoqlFieldName":
                words = c.word().lower()
                if words not in ("null", "true", "false", "asc", "desc", "nulls", "first", "last", "security_enforced", "user_mode", "system_mode", "rollup", "cube") and not words.startswith(("last_", "next_", "this_", "n_")) and words not in ("today", "yesterday", "tomorrow"):
                    self.use("soql_field", c.word(), obj, -1, c, within)
            else:
                todo += list(c.nodes())


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of every file; (path, local) is a symbol's id."""
    return relation(facts(files, ("symbols",)), "symbols").drop("type", "top")


def uses(files: DataFrame) -> DataFrame:
    """Names in use, before anything is resolved across files."""
    return relation(facts(files, ("uses",)), "uses").drop("type", "top")


def sid(path: str = "path", local: str = "local"):
    return F.concat_ws("#", F.col(path), F.col(local).cast("string"))


LOCALS = ("LocalVar", "Parameter", "CatchVar", "ForEachVar", "SwitchBindingVar")
# Words that are no names, and what platform interfaces ask for.
RESERVED = set("abstract and as break by catch class continue delete do else enum extends false final finally for from global if implements in insert instanceof interface limit merge new not null on or override private protected public return select static super switch testmethod this throw transient true try undelete update upsert virtual void webservice when where while".split())
INTERFACES = {"comparable": "compareto", "comparator": "compare", "schedulable": "execute", "queueable": "execute", "database.batchable": "start execute finish", "iterator": "hasnext next", "iterable": "iterator", "callable": "call", "installhandler": "oninstall", "uninstallhandler": "onuninstall"}
# Types of the language that no file declares.
BUILTIN = set("string integer long double decimal boolean date datetime time id blob object void sobject list set map iterator iterable exception type system database test schema json math limits userinfo trigger apexpages pagereference http httprequest httpresponse comparable schedulable queueable callable".split())
#: Most rounds in which types of chained receivers are found.
CHAIN = 24


def base_of(text: Column) -> Column:
    """The type named by a type's text, in lower case, without its arguments."""
    return F.lower(F.trim(F.regexp_extract(text, r"^:?([^<]*)", 1)))


def collection_member(text: Column, name: Column) -> Column:
    """Result type of a collection's member, by its type arguments; else null. The
    first argument of a map has no arguments of its own."""
    base, inner = base_of(text), F.regexp_extract(text, r"<(.*)>\s*$", 1)
    key = F.trim(F.regexp_extract(inner, r"^([^,<]*),", 1))
    value = F.trim(F.regexp_extract(inner, r"^[^,<]*,(.*)$", 1))
    some = lambda c: F.when(c != "", c)
    one, is_map = base.isin("list", "set", "iterator"), base == "map"
    got = F.when(one & name.isin("get", "remove", "next") & ~((base == "set") & (name == "remove")), some(inner)).when(is_map & name.isin("get", "remove", "put"), some(value))
    got = got.when(is_map & (name == "keyset") & (key != ""), F.concat(F.lit("Set<"), key, F.lit(">"))).when(is_map & (name == "values") & (value != ""), F.concat(F.lit("List<"), value, F.lit(">")))
    got = got.when((one | is_map) & (name == "size"), F.lit("Integer")).when((one | is_map) & name.isin("isempty", "contains", "containskey", "hasnext"), F.lit("Boolean"))
    got = got.when((one | is_map) & name.isin("clone", "deepclone"), F.regexp_replace(text, "^:", ""))
    return got.when(base.isin("list", "set") & (name == "iterator") & (inner != ""), F.concat(F.lit("Iterator<"), inner, F.lit(">")))


def with_owners(rows: DataFrame) -> DataFrame:
    """type_id and top_id instead of the places of the two in the file."""
    return rows.withColumn("type_id", F.when(F.col("type").isNotNull(), sid("path", "type"))).withColumn("top_id", F.when(F.col("top").isNotNull(), sid("path", "top"))).drop("type", "top")


def type_of_symbol() -> Column:
    return F.when(F.col("type_args").isNotNull(), F.concat("type_name", F.lit("<"), "type_args", F.lit(">"))).otherwise(F.col("type_name"))


class Program:
    """The relations of a corpus, made when they are first asked for. Each file is parsed
    once; symbols, uses and what is resolved from them are written once to the shared folder."""

    def __init__(self, files: DataFrame, schema: DataFrame | None = None, library: DataFrame | None = None, labels: DataFrame | None = None, known: DataFrame | None = None, controllers: DataFrame | None = None, only: tuple[str, ...] = tuple(RELATIONS)):
        """schema: (object, field) names that queries and code may use; null field rows
        name objects. library: (class_lc, name_lc, arity, return_type) of platform
        classes, arity -1 for properties. labels: (full_name). known: facts rows of
        the files, if they are at hand. controllers: (class_lc) of classes that pages name.
        only: the relations of facts that will be asked for, to spare the parse the others."""
        self.files = files
        self.schema, self.library, self.labels, self.controllers = schema, library, labels, controllers
        self.only, self._facts = tuple(known.columns[1:]) if known is not None else only, known
        self._symbols = self._uses = self._edges = self._closure = self._refs = self._result = None

    @property
    def facts(self) -> DataFrame:
        if self._facts is None:
            self._facts = cut(facts(self.files, self.only), "facts")
        return self._facts

    def _relation(self, name: str) -> DataFrame:
        """A relation of facts; the only one asked for comes straight from the parse."""
        return relation(facts(self.files, (name,)) if self._facts is None and self.only == (name,) else self.facts, name)

    @property
    def symbols(self) -> DataFrame:
        """Declarations with their ids, and those of the type that each belongs to and of
        the outermost declaration."""
        if self._symbols is None:
            s = self._relation("symbols").withColumn("id", sid()).withColumn("container_id", F.when(F.col("container") >= 0, sid("path", "container"))).withColumn("name_lc", F.lower("name"))
            self._symbols = cut(with_owners(s), "symbols")
        return self._symbols

    @property
    def uses(self) -> DataFrame:
        if self._uses is None:
            u = self._relation("uses").withColumn("name_lc", F.lower("name")).withColumn("within_id", sid("path", "within")).withColumn("rid", F.concat_ws("@", "path", F.col("ref").cast("string")))
            self._uses = cut(with_owners(u), "uses")
        return self._uses

    @property
    def types(self) -> DataFrame:
        return self.symbols.where("kind in ('Class','Interface','Enum')").select("id", "path", "kind", "name_lc", "container_id", "supers", "modifiers", "visibility")

    @property
    def owner(self) -> DataFrame:
        """(id, type_id, top_id): the type that a symbol belongs to, and the outermost one."""
        return self.symbols.select("id", "type_id", "top_id")

    @property
    def edges(self) -> DataFrame:
        """(sub, super) between types; a nested type of the same name comes before a global one."""
        if self._edges is None:
            raw = self.types.select(F.col("id").alias("sub"), F.coalesce("container_id", "id").alias("scope"), F.explode(F.split(F.lower("supers"), ",")).alias("name_lc")).where("name_lc <> ''")
            self._edges = cut(self._by_type_name(raw, "sub").select("sub", F.col("target").alias("super")), "edges")
        return self._edges

    def _by_type_name(self, raw: DataFrame, key: str) -> DataFrame:
        """raw(key, scope, name_lc) with the type that the name means, if any: one nested
        in the scope, else a global one; after a dot, one nested in a type of the name before."""
        words = F.split("name_lc", r"\.")
        raw = raw.select(key, "scope", "name_lc", F.element_at(words, -1).alias("__last"), F.when(F.size(words) > 1, F.element_at(words, -2)).alias("__outer"))
        nested = self.types.where("container_id is not null").select(F.col("id").alias("__id"), F.col("name_lc").alias("__last"), F.col("container_id").alias("scope"))
        holders = self.types.select(F.col("id").alias("scope"), F.col("name_lc").alias("__holder"))
        nested = nested.groupBy("scope", "__last").agg(F.min("__id").alias("__id")).join(holders, "scope", "left")
        everywhere = self.types.where("container_id is null").groupBy(F.col("name_lc").alias("__last")).agg(F.min("id").alias("target"))
        of_holder = nested.where("__holder is not null").groupBy("__last", F.col("__holder").alias("__outer")).agg(F.min("__id").alias("target"))
        own = raw.join(nested, ["scope", "__last"]).where("__outer is null or __outer = __holder").select(key, "name_lc", F.lit(0).alias("r"), F.col("__id").alias("target"))
        bare = lookup(raw.where("__outer is null"), everywhere, ["__last"]).select(key, "name_lc", F.lit(1).alias("r"), "target")
        dotted = raw.where("__outer is not null").join(of_holder, ["__last", "__outer"]).select(key, "name_lc", F.lit(1).alias("r"), "target")
        return own.unionByName(bare).unionByName(dotted).groupBy(key, "name_lc").agg(F.min(F.struct("r", "target")).alias("m")).select(key, "name_lc", F.col("m.target").alias("target"))

    @property
    def closure(self) -> DataFrame:
        """(sub, super, depth) along all chains, cycle-safe."""
        if self._closure is None:
            self._closure = closure(self.edges, "sub", "super")
        return self._closure

    def _members(self, m: DataFrame, shared: bool = False) -> DataFrame:
        """(rid, target_id) of member uses (rid, kind, name_lc, arity, args, on_type, step,
        top_id): the members of least step along the supertypes that can be seen from
        the use, overloads narrowed by the arguments' types. shared: very
        many uses may be on one type."""
        meet = lookup if shared else lambda a, b, on: a.join(b, on)
        chain = self.closure.select(F.col("sub").alias("on_type"), F.col("super").alias("holder"), "depth")
        own = ["rid", "kind", "name_lc", "arity", "args", "top_id"]
        reach = m.select(*own, F.col("on_type").alias("holder"), "step").unionByName(meet(m, chain, ["on_type"]).select(*own, "holder", (F.col("step") + F.col("depth")).alias("step")))
        reach = cut(reach, "reach") if shared else reach
        s = self.symbols.where("kind in ('Method','Field','Property','EnumConstant')").select(F.col("id").alias("target_id"), F.col("container_id").alias("holder"), "name_lc", F.col("kind").alias("m_kind"), F.col("arity").alias("m_arity"), "params", "visibility", F.col("top_id").alias("own_top"))
        fits = F.when(F.col("kind") == "method", (F.col("m_kind") == "Method") & (F.col("m_arity") == F.col("arity"))).otherwise(F.col("m_kind") != "Method")
        seen = (F.col("visibility") != "private") | (F.col("own_top") == F.col("top_id"))
        hit = meet(reach, s, ["holder", "name_lc"]).where(fits & seen)
        best = hit.groupBy("rid").agg(F.min("step").alias("least"))
        hit = hit.join(best, "rid").where("step = least").select("rid", "target_id", "params", "args").distinct()
        return self._narrowed(hit)

    def _narrowed(self, hit: DataFrame) -> DataFrame:
        """hit (rid, target_id, params, args) without the overloads that the types of
        the arguments rule out; several stay where the types do not tell."""
        per = hit.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("target_id", "params"))).alias("c"), F.first("args").alias("args"))
        one, many = per.where("size(c) = 1"), per.where("size(c) > 1 and coalesce(args, '') <> ''")
        rest = per.where("size(c) > 1 and coalesce(args, '') = ''")
        ups = self.types.select("id", "name_lc").join(self.closure.select(F.col("sub").alias("id"), "super"), "id").join(self.types.select(F.col("id").alias("super"), F.col("name_lc").alias("up")), "super")
        ups = ups.groupBy(F.col("name_lc").alias("a")).agg(F.array_sort(F.collect_set("up")).alias("ups"))
        mine = self.types.select(F.col("name_lc").alias("a")).distinct().join(ups, "a", "left").select("a", F.coalesce("ups", F.array().cast("array<string>")).alias("ups"))
        names = many.select("rid", F.explode(F.array_distinct(F.transform(F.concat(F.split("args", ";"), F.flatten(F.transform("c", lambda x: F.split(x["params"], ";")))), base_of))).alias("a")).join(mine, "a").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("a", "ups"))).alias("ups"))

        def pick(frames):
            import pandas as pd

            for f in frames:
                rows = []
                for rid, c, args, known in zip(f["rid"], f["c"], f["args"], f["ups"], strict=True):
                    above = {k: set(v) for k, v in (known or {}).items()} if known is not None else {}
                    params = [x["params"].split(";") if x["params"] else [] for x in c]
                    rows += [(rid, c[i]["target_id"]) for i in pick_overload(params, [None if a == "?" else a for a in args.split(";")], above)]
                yield pd.DataFrame(rows, columns=["rid", "target_id"])

        some = many.join(names, "rid", "left").mapInPandas(pick, "rid string, target_id string")
        plain = one.unionByName(rest).select("rid", F.explode("c.target_id").alias("target_id"))
        return plain.unionByName(some)

    @property
    def result_types(self) -> DataFrame:
        """(rid, type_text): the type that a resolved use has as an expression."""
        self.refs  # noqa: B018  fills it
        return self._result

    @property
    def refs(self) -> DataFrame:
        """Uses with outcome and target_id: Resolved, SchemaObject, SchemaField, Library,
        Label, UnknownSchema, Statement or Unresolved. Receivers are this, super, a local
        or member and its type, a type's name, or a chain of members, whose types are
        found round by round: a member's declared type, or what a collection or a
        platform class gives."""
        if self._refs is None:
            u = self.uses
            local = u.where("local >= 0").select("rid", sid("path", "local").alias("target_id"))
            scoped = u.where("local = -1")
            tn = scoped.where("kind in ('type','new')").select("rid", F.col("top_id").alias("scope"), "name_lc")
            types = cut(self._by_type_name(tn, "rid").select("rid", F.col("target").alias("target_id")), "types")
            own = ["rid", "kind", "name_lc", "arity", "args", "top_id"]

            # members of the class at hand, of its outer class, of this and super
            bare = scoped.where("kind in ('method','name') and receiver is null or kind in ('method','field') and receiver in ('this','super')")
            at_hand = bare.select(*own, F.col("type_id").alias("on_type"), F.lit(0).alias("step"))
            outer = bare.where("receiver is null and top_id <> type_id").select(*own, F.col("top_id").alias("on_type"), F.lit(1000).alias("step"))
            members = cut(self._members(at_hand.unionByName(outer)), "members")
            named = scoped.where("kind = 'name'").join(members.select("rid").distinct(), "rid", "left_anti").select("rid", F.col("top_id").alias("scope"), "name_lc")
            as_type = self._by_type_name(named, "rid").select("rid", F.col("target").alias("target_id"))

            # constructors: of new, this(...) and super(...)
            ctor = self.symbols.where("kind = 'Constructor'").select(F.col("id").alias("c_id"), F.col("container_id").alias("made_type"), F.col("arity").alias("c_arity"), "params")
            made = scoped.where("kind = 'new'").select("rid", "arity", "args").join(types.withColumnRenamed("target_id", "made_type"), "rid")
            own_type = scoped.where("kind = 'constructor' and receiver = 'this'").select("rid", "arity", "args", F.col("type_id").alias("made_type"))
            above = scoped.where("kind = 'constructor' and receiver = 'super'").select("rid", "arity", "args", "type_id").join(self.closure.where("depth = 1").select(F.col("sub").alias("type_id"), F.col("super").alias("made_type")), "type_id").drop("type_id")
            made = made.unionByName(own_type).unionByName(above).join(ctor, "made_type").where("arity = c_arity").select("rid", F.col("c_id").alias("target_id"), "params", "args")
            made = self._narrowed(made)

            # members of receivers with a type: known from the file, or from the receiver's own use
            decl = self.symbols.where("kind in ('Method','Field','Property','EnumConstant')").select(F.col("id").alias("target_id"), type_of_symbol().alias("type_text"))

            def types_of(got: DataFrame) -> DataFrame:
                t = lookup(got, decl, ["target_id"]).groupBy("rid").agg(F.min("type_text").alias("type_text"), F.count_distinct("type_text").alias("n"))
                return t.where("n = 1 and type_text is not null and lower(type_text) <> 'void'").select("rid", "type_text")

            todo = scoped.where("kind in ('method','field') and receiver is not null and receiver not in ('this','super')")
            place = u.select(F.col("path").alias("r_path"), F.col("start").alias("r_start"), F.col("rid").alias("recv_rid")).where("r_start >= 0")
            waits = todo.where("recv_ref >= 0").join(place, (F.col("path") == F.col("r_path")) & (F.col("recv_ref") == F.col("r_start"))).select(*own, "recv_rid")
            waits = cut(waits, "waits")
            typed = cut(types_of(members), "typed")
            plain = todo.where("receiver <> '?'")
            shadowed = plain.where("not startswith(receiver, ':') and recv_ref >= 0").join(waits.join(typed.select(F.col("rid").alias("recv_rid")), "recv_rid").select("rid"), "rid", "left_semi").select("rid")
            ready = plain.join(shadowed, "rid", "left_anti").select(*own, F.col("receiver").alias("on_text"))
            fresh, found, extern = typed, [], []
            for _ in range(CHAIN):
                ready = ready.unionByName(waits.join(fresh.withColumnRenamed("rid", "recv_rid"), "recv_rid").select(*own, F.concat(F.lit(":"), "type_text").alias("on_text")))
                ready = cut(ready, "ready")
                if not ready.take(1):
                    break
                on = self._by_type_name(ready.select("rid", F.col("top_id").alias("scope"), base_of(F.col("on_text")).alias("name_lc")), "rid").select("rid", F.col("target").alias("on_type"))
                got = cut(self._members(cut(ready.join(on, "rid").select(*own, "on_type", F.lit(0).alias("step")), "on"), True), "members")
                found.append(got)
                lib = ready.select("rid", collection_member(F.col("on_text"), F.col("name_lc")).alias("type_text")).where("type_text is not null")
                if self.library is not None:
                    known = self.library.select("class_lc", F.col("name_lc").alias("l_name"), F.col("arity").alias("l_arity"), "return_type")
                    more = ready.join(known, (base_of(F.col("on_text")) == F.col("class_lc")) & (F.col("name_lc") == F.col("l_name")) & ((F.col("arity") == F.col("l_arity"))))
                    lib = lib.unionByName(more.groupBy("rid").agg(F.min("return_type").alias("type_text")))
                lib = cut(lib.join(got.select("rid"), "rid", "left_anti"), "library")
                extern.append(lib)
                fresh = cut(types_of(got).unionByName(lib.where("type_text is not null")), "typed")
                typed = typed.unionByName(fresh)
                ready = ready.limit(0)
            else:
                raise RuntimeError("chains of receivers did not settle")
            got = local.unionByName(types).unionByName(members).unionByName(as_type).unionByName(made)
            for f in found:
                got = got.unionByName(f)
            out = u.join(got.distinct(), "rid", "left")
            lib = None
            for x in extern:
                lib = x.select("rid") if lib is None else lib.unionByName(x.select("rid"))
            out = out.join(lib.distinct().withColumn("__lib", F.lit(True)), "rid", "left") if lib is not None else out.withColumn("__lib", F.lit(None).cast("boolean"))
            label = F.lit(False)
            if self.labels is not None:
                l = self.labels.select(F.lower("full_name").alias("l_name")).distinct().withColumn("__label", F.lit(True))
                out = out.join(l, (F.col("kind") == "field") & F.lower("receiver").isin("label", "system.label") & (F.col("name_lc") == F.col("l_name")), "left")
                label = F.coalesce("__label", F.lit(False))
            unknown = field = record = F.lit(False)
            builtin = F.col("kind").isin("type", "new") & (F.col("name_lc").isin(*sorted(BUILTIN)) | F.col("name_lc").startswith("database.") | F.col("name_lc").startswith("system."))
            if self.schema is not None:
                objects = self.schema.select(F.lower("object").alias("s_obj")).distinct()
                fields = self.schema.where("field is not null").select(F.lower("object").alias("f_obj"), F.lower("field").alias("f_name")).distinct()
                typed_recv = base_of(F.when(F.col("receiver").startswith(":"), F.col("receiver")))
                out = out.withColumn("__obj", F.when(F.col("kind") == "soql_object", F.col("name_lc")).when(F.col("kind") == "soql_field", F.lower("receiver")).when(F.col("kind") == "field", typed_recv).when(F.col("kind").isin("type", "new"), F.col("name_lc")))
                out = out.join(objects, F.col("__obj") == F.col("s_obj"), "left").join(fields, F.col("kind").isin("soql_field", "field") & (F.col("__obj") == F.col("f_obj")) & (F.element_at(F.split("name_lc", r"\."), 1) == F.col("f_name")), "left")
                unknown = F.col("kind").isin("soql_object", "soql_field") & (F.col("s_obj").isNull() | (F.col("kind") == "soql_field") & F.col("f_name").isNull())
                field = (F.col("kind") == "field") & F.col("f_name").isNotNull()
                record = F.col("kind").isin("type", "new") & F.col("s_obj").isNotNull()
            outcome = F.when(F.col("target_id").isNotNull(), "Resolved").when(label, "Label").when(F.coalesce("__lib", F.lit(False)) | builtin, "Library").when(record, "SchemaObject").when(unknown, "UnknownSchema").when(field, "SchemaField").when(F.col("kind").isin("soql_object", "soql_field"), "SchemaObject").when(F.col("kind").isin("dml", "soql", "sosl", "soql_child"), "Statement").otherwise("Unresolved")
            refs = out.select("rid", "path", "ref", "kind", "name", "receiver", "arity", "start", "end", "within_id", "type_id", "top_id", "in_loop", "target_id", outcome.alias("outcome"))
            self._refs = cut(refs, "refs")
            self._result = cut(typed, "result_types")
        return self._refs

    # -- lookups -----------------------------------------------------------
    def references_to(self, target_id: str) -> DataFrame:
        return self.refs.where(F.col("target_id") == target_id).select("path", "start", "end")

    def symbol_at(self, points: DataFrame) -> DataFrame:
        """points (path, offset) with the symbols declared or used there."""
        decl = self.symbols.select(F.col("path").alias("p"), F.col("name_start").alias("s"), F.col("name_end").alias("e"), "id")
        used = self.refs.where("target_id is not null").select(F.col("path").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("target_id").alias("id"))
        both = decl.unionByName(used)
        return points.join(both, (F.col("path") == F.col("p")) & (F.col("offset") >= F.col("s")) & (F.col("offset") < F.col("e"))).select(*points.columns, "id").distinct()

    def call_edges(self) -> DataFrame:
        """(caller, callee, sites) of resolved calls."""
        callee = self.symbols.where("kind in ('Method','Constructor')").select(F.col("id").alias("target_id"))
        calls = lookup(self.refs.where("kind in ('method','new') and target_id is not null").select("within_id", "target_id", "start", "end"), callee, ["target_id"])
        return calls.groupBy(F.col("within_id").alias("caller"), F.col("target_id").alias("callee")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("sites"))

    def workspace_symbols(self, text: str) -> DataFrame:
        return self.symbols.where(~F.col("kind").isin(*LOCALS) & F.contains("name_lc", F.lit(text.lower()))).select("id", "kind", "name", "path", "name_start")

    def family(self, target_id: str) -> DataFrame:
        """(id): a method with all that it overrides or that overrides it, whatever
        the way between them; any other symbol alone."""
        from .editor import dispatch

        both = dispatch(self)
        pairs = both.select(F.col("base").alias("a"), F.col("override").alias("b"))
        pairs = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "overrides")
        got = fresh = self.symbols.where(F.col("id") == target_id).select("id")
        while True:
            fresh = cut(fresh.join(pairs, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(got, "id", "left_anti"), "family")
            if not fresh.take(1):
                return got
            got = got.unionByName(fresh)

    def rename_refusal(self, target_id: str, new_name: str) -> str | None:
        """Why a symbol cannot take a name: it is no name, a constructor goes with its
        type, the platform calls the member by its name, or the name is taken where any
        of the family is declared or used."""
        found = self.symbols.where(F.col("id") == target_id).first()
        if found is None:
            return "no such symbol"
        if not re.fullmatch(r"[A-Za-z](?:_?[A-Za-z0-9])*", new_name) or new_name.lower() in RESERVED:
            return f"{new_name!r} is no name"
        if found["kind"] == "Constructor":
            return "a constructor has its type's name"
        if new_name.lower() == found["name_lc"]:
            return None
        family = cut(self.family(target_id), "family")
        own = self.symbols.join(family, "id")
        if own.join(self.platform_members(), "id", "left_semi").take(1):
            return "the platform calls it by this name"
        same = self.symbols.where(F.col("name_lc") == new_name.lower())
        if found["kind"] in LOCALS:
            taken = same.where(F.col("kind").isin(*LOCALS) & (F.col("path") == found["path"]) & F.col("container").eqNullSafe(F.lit(found["container"])))
            return f"{new_name} is a name in the same body" if taken.take(1) else None
        if found["kind"] in ("Class", "Interface", "Enum"):
            taken = same.where("kind in ('Class','Interface','Enum')").where(F.col("container_id").eqNullSafe(F.lit(found["container_id"])))
            return f"there is a type {new_name}" if taken.take(1) else None
        rivals = same.where((F.col("kind") == "Method") & (F.col("arity") == found["arity"]) if found["kind"] == "Method" else F.col("kind").isin("Field", "Property", "EnumConstant"))
        holders = own.select("container_id").distinct()
        near = holders.unionByName(self.closure.join(holders, F.col("sub") == F.col("container_id")).select(F.col("super").alias("container_id"))).unionByName(self.closure.join(holders, F.col("super") == F.col("container_id")).select(F.col("sub").alias("container_id")))
        if rivals.join(near.distinct(), "container_id", "left_semi").take(1):
            return f"{new_name} is a member of the type, or of one above or below it"
        if found["kind"] != "Method":
            # a local of the new name would hide the member where it is used bare
            users = self.refs.join(family.withColumnRenamed("id", "target_id"), "target_id").where("kind = 'name'").select(F.col("within_id").alias("container_id")).distinct()
            if same.where(F.col("kind").isin(*LOCALS)).join(users, "container_id", "left_semi").take(1):
                return f"a local {new_name} would hide it"
        return None

    def rename_edits(self, target_id: str, new_name: str) -> DataFrame:
        """(path, start, end, new_text) of the declarations and uses of a symbol's
        family; a type's constructors follow it. ValueError where it is refused."""
        why = self.rename_refusal(target_id, new_name)
        if why:
            raise ValueError(why)
        family = self.family(target_id)
        makers = self.symbols.where("kind = 'Constructor'").join(family.withColumnRenamed("id", "container_id"), "container_id", "left_semi").select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"))
        decl = self.symbols.join(family, "id").select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end")).unionByName(makers)
        used = self.refs.where("kind <> 'constructor'").join(family.withColumnRenamed("id", "target_id"), "target_id").select("path", "start", "end")
        return decl.unionByName(used).distinct().withColumn("new_text", F.lit(new_name))

    def platform_members(self) -> DataFrame:
        """(id): methods that a platform interface of their class asks for, by the
        fixed list and by the library, and members of classes that pages name."""
        names = F.split(F.lower("supers"), ",")
        asked = self.files.sparkSession.createDataFrame([(i, m) for i, ms in INTERFACES.items() for m in ms.split()], "iface string, name_lc string")
        if self.library is not None:
            asked = asked.unionByName(self.library.where("arity >= 0").select(F.col("class_lc").alias("iface"), "name_lc")).distinct()
        stated = self.types.select("id", F.explode(names).alias("iface")).where("iface <> ''")
        mine = self.types.select(F.col("name_lc").alias("iface")).distinct()
        stated = stated.join(mine, "iface", "left_anti")
        every = stated.unionByName(self.closure.join(stated.withColumnRenamed("id", "super"), "super").select(F.col("sub").alias("id"), "iface"))
        need = every.join(asked, "iface").select(F.col("id").alias("container_id"), "name_lc")
        out = self.symbols.where("kind = 'Method'").join(need.distinct(), ["container_id", "name_lc"], "left_semi").select("id")
        if self.controllers is not None:
            named = self.types.join(self.controllers.select(F.col("class_lc").alias("name_lc")), "name_lc", "left_semi").select(F.col("id").alias("container_id"))
            out = out.unionByName(self.symbols.where("kind in ('Method','Field','Property','Constructor') and visibility in ('public','global')").join(named, "container_id", "left_semi").select("id"))
        return out.distinct()

    def outline(self) -> DataFrame:
        """Declarations with their children's names, a level at a time."""
        shown = self.symbols.where(~F.col("kind").isin(*LOCALS))
        kids = shown.groupBy(F.col("container_id").alias("of_id")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "name"))).alias("children"))
        return shown.select("id", "path", "kind", "name", "start", "end").join(kids, F.col("id") == F.col("of_id"), "left").drop("of_id")

    def top_k_per_type(self, k: int) -> DataFrame:
        """The k most referenced members of each type."""
        n = self.refs.where("target_id is not null").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
        m = self.symbols.where("kind in ('Method','Field','Property')").join(n, F.col("id") == F.col("target_id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
        w = Window.partitionBy("container_id").orderBy(F.desc("n"), "name_lc", "id")
        return m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("container_id", "id", "name", "n", "r")
