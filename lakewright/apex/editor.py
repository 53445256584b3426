"""What an editor asks of a program: places, outlines, calls, completion.

Questions come as DataFrames of positions, so that one or many are one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import lookup
from ..storage import cut
from .bind import LOCALS, Program
from .corpus import Lines, is_trigger, nodes, per_file
from .lexer import COMMENTS
from .parser import parse

FOLDS = ("ClassBody", "InterfaceBody", "Block", "EnumDecl", "SwitchStmt", "PropertyDecl", "SoqlExpr")


def enclosing(p: Program, points: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """points (path, offset) with the id of the innermost symbol of the kinds around them."""
    s = p.symbols.where(F.col("kind").isin(*kinds)).select(F.col("path").alias("p"), "start", "end", "id")
    j = points.join(s, (F.col("path") == F.col("p")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")), "left")
    return j.groupBy(*points.columns).agg(F.min_by("id", F.col("end") - F.col("start")).alias("id"))


def enclosing_callable(p: Program, points: DataFrame) -> DataFrame:
    return enclosing(p, points, ("Method", "Constructor"))


def enclosing_type(p: Program, points: DataFrame) -> DataFrame:
    return enclosing(p, points, ("Class", "Interface", "Enum", "Trigger"))


def definition(p: Program, points: DataFrame) -> DataFrame:
    """Where the names at points are declared."""
    at = p.symbol_at(points)
    return at.join(p.symbols.select("id", F.col("path").alias("target_path"), "name_start", "name_end"), "id")


def references(p: Program, points: DataFrame, declaration: bool = True, same_file: bool = False) -> DataFrame:
    """Uses of the symbols at points, and their declarations if asked for."""
    at = p.symbol_at(points).select(F.col("path").alias("asked"), "id").distinct()
    used = p.refs.where("target_id is not null").select(F.col("target_id").alias("id"), "path", "start", "end")
    if declaration:
        used = used.unionByName(p.symbols.select("id", "path", F.col("name_start").alias("start"), F.col("name_end").alias("end")))
    out = at.join(used, "id")
    return (out.where("asked = path") if same_file else out).select("path", "start", "end").distinct()


def incoming_calls(p: Program, target_id: str) -> DataFrame:
    return p.call_edges().where(F.col("callee") == target_id).select("caller", "sites")


def outgoing_calls(p: Program, caller_id: str) -> DataFrame:
    """Callees of a method; a virtual target stands for its overrides too."""
    edges = p.call_edges().where(F.col("caller") == caller_id)
    return edges.select("callee", "sites").unionByName(edges.join(dispatch(p), F.col("callee") == F.col("base")).select(F.col("override").alias("callee"), "sites"))


def dispatch(p: Program) -> DataFrame:
    """(base, override): methods of subtypes with the name and arity of a virtual,
    abstract or interface method."""
    m = p.symbols.where("kind = 'Method'")
    words = F.split("modifiers", " ")
    inter = p.types.where("kind = 'Interface'").select(F.col("id").alias("container_id"), F.lit(True).alias("inter"))
    base = m.join(inter, "container_id", "left").where(F.array_contains(words, "virtual") | F.array_contains(words, "abstract") | F.coalesce("inter", F.lit(False)))
    base = base.select(F.col("id").alias("base"), F.col("container_id").alias("super"), "name_lc", "arity")
    # from the subtypes up: very many of them may have one supertype
    over = cut(p.closure.join(m.select(F.col("id").alias("override"), F.col("container_id").alias("sub"), "name_lc", "arity"), "sub").select("override", "super", "name_lc", "arity"), "over")
    return lookup(over, base, ["super", "name_lc", "arity"]).select("base", "override")


def signature(p: Program) -> DataFrame:
    """(id, text) of callables and variables as a reader would see them."""
    ps = p.symbols.where("kind = 'Parameter'").groupBy(F.col("container_id").alias("of_id")).agg(F.array_sort(F.collect_list(F.struct("start", F.concat_ws(" ", typed(), "name").alias("t")))).alias("ps"))
    s = p.symbols.join(ps, F.col("id") == F.col("of_id"), "left")
    args = F.concat(F.lit("("), F.array_join(F.transform(F.coalesce("ps", F.array().cast("array<struct<start:int,t:string>>")), lambda x: x["t"]), ", "), F.lit(")"))
    text = F.concat_ws(" ", F.nullif("modifiers", F.lit("")), typed(), "name")
    return s.select("id", F.when(F.col("kind").isin("Method", "Constructor"), F.concat(text, args)).otherwise(text).alias("text"))


def typed():
    return F.when(F.col("type_args").isNotNull(), F.concat("type_name", F.lit("<"), "type_args", F.lit(">"))).otherwise(F.col("type_name"))


def doc_comments(p: Program) -> DataFrame:
    """(id, text): the doc comment right before a declaration."""

    def rows(path: str, text: str) -> list[tuple]:
        tree, lines, out, last = parse(text, is_trigger(path)), Lines(text), [], None
        for t in tree.tokens:
            if t.kind == "DocComment":
                last = t.text
            elif t.kind not in COMMENTS and t.kind != "Whitespace":
                if last:
                    out.append((path, lines.byte(t.start), last))
                last = None
        return out

    c = per_file(p.files, "path string, start int, text string", rows)
    return p.symbols.where(~F.col("kind").isin(*LOCALS)).join(c, ["path", "start"]).select("id", "text")


def hover(p: Program, points: DataFrame) -> DataFrame:
    """Signature and doc comment of the symbol at each point; of several the
    first, with how many more there are."""
    at = p.symbol_at(points).join(signature(p).withColumnRenamed("text", "sig"), "id").join(doc_comments(p).withColumnRenamed("text", "doc"), "id", "left")
    g = at.groupBy(*points.columns).agg(F.min(F.struct("id", "sig", "doc")).alias("m"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > 1, F.format_string(" (+%d more)", F.col("n") - 1)).otherwise("")
    return g.select(*points.columns, F.concat_ws("\n", F.concat(F.col("m.sig"), more), F.col("m.doc")).alias("text"))


def folding_ranges(p: Program) -> DataFrame:
    """Bodies that span lines: (path, start_line, end_line), 1-based."""

    def rows(path: str, text: str) -> list[tuple]:
        lines = Lines(text)
        return [(path, lines.line_col(n.start)[0], lines.line_col(n.end - 1)[0]) for n in parse(text, is_trigger(path)).root.walk() if n.kind in FOLDS and n.children]

    return per_file(p.files, "path string, start_line int, end_line int", rows).where("start_line < end_line").distinct()


def selection_chain(p: Program, points: DataFrame) -> DataFrame:
    """(path, offset, level, start, end): ranges around each point, innermost first."""
    n = nodes(p.files).where("start >= 0").select(F.col("path").alias("p"), "start", "end").distinct()
    j = points.join(n, (F.col("path") == F.col("p")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    w = Window.partitionBy("path", "offset").orderBy(F.col("end") - F.col("start"))
    return j.select("path", "offset", (F.row_number().over(w) - 1).alias("level"), "start", "end")


def test_lenses(p: Program) -> DataFrame:
    """Test classes and methods: (path, id, name, kind)."""
    notes, words = F.split("annotations", ","), F.split("modifiers", " ")
    is_test = F.array_contains(notes, "istest") | F.array_contains(words, "testmethod")
    return p.symbols.where(F.col("kind").isin("Class", "Method") & is_test).select("path", "id", "name", "kind", "name_start")


def semantic_tokens(p: Program) -> DataFrame:
    """(path, start, end, kind, gap): declarations and resolved uses in order, one
    per place, with the distance from the one before."""
    decl = p.symbols.select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"), "kind")
    kinds = p.symbols.select(F.col("id").alias("target_id"), F.col("kind").alias("k"))
    used = p.refs.where("target_id is not null").join(kinds, "target_id").select("path", "start", "end", F.col("k").alias("kind"))
    one = decl.unionByName(used).groupBy("path", "start").agg(F.min(F.struct("end", "kind")).alias("m"))
    w = Window.partitionBy("path").orderBy("start")
    return one.select("path", "start", F.col("m.end").alias("end"), F.col("m.kind").alias("kind"), (F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0))).alias("gap"))


def member_candidates(p: Program, type_id: str) -> DataFrame:
    """Members that complete a name on a type: own first, then inherited, one per name."""
    holders = p.closure.where(F.col("sub") == type_id).select(F.col("super").alias("holder"), "depth")
    own = p.types.where(F.col("id") == type_id).select(F.col("id").alias("holder"), F.lit(0).alias("depth"))
    m = p.symbols.where("kind in ('Method','Field','Property','EnumConstant')").select(F.col("container_id").alias("holder"), "name", "name_lc", "kind", "visibility", "id")
    j = own.unionByName(holders).join(m, "holder").where("depth = 0 or visibility <> 'private'")
    best = j.groupBy("name_lc").agg(F.min(F.struct("depth", "id", "name", "kind")).alias("m"))
    return best.select(F.col("m.name").alias("name"), F.col("m.kind").alias("kind"), F.col("m.id").alias("id"), F.col("m.depth").alias("tier")).orderBy("tier", "name")


def name_candidates(p: Program, points: DataFrame) -> DataFrame:
    """Locals and types that complete a bare name: locals before types."""
    c = enclosing_callable(p, points)
    loc = c.join(p.symbols.where(F.col("kind").isin(*LOCALS)).select(F.col("container_id").alias("id"), "name", "kind", F.col("start").alias("s")), "id").where("s <= offset").select(*points.columns, "name", "kind", F.lit(0).alias("tier"))
    types = p.types.where("container_id is null").join(p.symbols.select("id", "name"), "id").select("name", "kind", F.lit(4).alias("tier"))
    return loc.unionByName(points.crossJoin(types).select(*loc.columns)).distinct().orderBy("tier", "name")


def inlay_hints(p: Program) -> DataFrame:
    """(path, start, name): parameter names before arguments that do not already spell them."""

    def rows(path: str, text: str) -> list[tuple]:
        lines, out = Lines(text), []
        for n in parse(text, is_trigger(path)).root.walk():
            args = n.child("ArgList") if n.kind in ("CallExpr", "MethodCallExpr", "NewExpr") else None
            if args is None:
                continue
            name = n.children[0] if n.kind == "CallExpr" else n.child("Type") if n.kind == "NewExpr" else [c for c in n.nodes() if c.kind == "DeclName"][-1]
            for k, a in enumerate(args.nodes()):
                out.append((path, lines.byte(name.start), k, lines.byte(a.start), text[a.start: a.end].lower()))
        return out

    args = per_file(p.files, "path string, at int, k int, start int, text string", rows)
    calls = p.refs.where("kind in ('method','new') and target_id is not null").select("path", F.col("start").alias("at"), F.col("target_id").alias("callee"))
    w = Window.partitionBy("container_id").orderBy("start")
    params = p.symbols.where("kind = 'Parameter'").select("container_id", "name", "name_lc", (F.row_number().over(w) - 1).alias("k"))
    j = lookup(cut(args.join(calls, ["path", "at"]), "args"), params.withColumnRenamed("container_id", "callee"), ["callee", "k"])
    return j.where("text <> name_lc").select("path", "start", "name")


def signature_help(p: Program, name: str, active: int, given: int) -> DataFrame:
    """Overloads of a name; the active one has the number of arguments given, or
    is the first with room for the active parameter, or the first."""
    o = p.symbols.where((F.col("name_lc") == name.lower()) & F.col("kind").isin("Method", "Constructor")).select("id", "arity", "params")
    rank = F.when(F.col("arity") == given, 0).when(F.col("arity") > active, 1).otherwise(2)
    w = Window.orderBy(rank, "arity", "id")  # a handful of overloads
    return o.withColumn("active", F.row_number().over(w) == 1)


def reorder_parameters(p: Program, target_id: str, order: list[int]) -> DataFrame:
    """(path, start, end, new_text): edits of a method's parameter list and of
    every resolved call, to the given order; what it leaves out is removed."""

    def rows(path: str, text: str) -> list[tuple]:
        lines, out = Lines(text), []
        for n in parse(text, is_trigger(path)).root.walk():
            lst = n.child("FormalParamList", "ArgList")
            if lst is None:
                continue
            name = n.child("DeclName") if lst.kind == "FormalParamList" else n.children[0] if n.kind == "CallExpr" else n.child("Type") if n.kind == "NewExpr" else next((c for c in reversed(list(n.nodes())) if c.kind == "DeclName"), None)
            items = list(lst.nodes())
            if name is not None and items and max(order, default=-1) < len(items):
                new = ", ".join(text[items[k].start: items[k].end] for k in order)
                out.append((path, lines.byte(name.start), lines.byte(items[0].start), lines.byte(items[-1].end), new))
        return out

    lists = per_file(p.files, "path string, at int, start int, end int, new_text string", rows)
    sites = p.symbols.where(F.col("id") == target_id).select("path", F.col("name_start").alias("at"))
    sites = sites.unionByName(p.refs.where((F.col("target_id") == target_id) & F.col("kind").isin("method", "new")).select("path", F.col("start").alias("at")))
    return lists.join(sites.distinct(), ["path", "at"]).select("path", "start", "end", "new_text")


def schema_location(p: Program, fields: DataFrame) -> DataFrame:
    """(path, start, end, source_path): the metadata file of each field that a query
    names; fields as metadata.fields gives them."""
    f = fields.select(F.lower("object").alias("o"), F.lower("api_name").alias("n"), "source_path")
    u = p.refs.where("kind = 'soql_field'").withColumn("n", F.element_at(F.split(F.lower("name"), r"\."), 1))
    return u.join(f, (F.lower("receiver") == F.col("o")) & (u["n"] == f["n"])).select("path", "start", "end", "source_path")


def label_location(p: Program, labels: DataFrame) -> DataFrame:
    """(path, start, end, source_path): the file of each label that code names."""
    l = labels.select(F.lower("full_name").alias("l"), "source_path")
    return p.refs.where("outcome = 'Label'").join(l, F.lower("name") == F.col("l")).select("path", "start", "end", "source_path")


def page_location(p: Program, pages: DataFrame) -> DataFrame:
    """(id, page): pages that name a class as their controller or extension."""
    c = pages.select(F.col("path").alias("page"), F.explode("controllers").alias("name_lc"))
    return p.types.join(c, "name_lc").select("id", "page")


def visible_candidates(p: Program, type_id: str, from_id: str) -> DataFrame:
    """member_candidates of a type that can be seen from another type: public ones,
    protected ones from below, private ones inside the same outermost type."""
    tops = {r["id"]: r["top_id"] for r in p.owner.where(F.col("id").isin(type_id, from_id)).select("id", "top_id").collect()}
    below = bool(p.closure.where((F.col("sub") == from_id) & (F.col("super") == type_id)).take(1)) or from_id == type_id
    seen = member_candidates(p, type_id).join(p.symbols.select("id", "visibility"), "id")
    inside = tops.get(type_id) == tops.get(from_id)
    return seen.where(F.col("visibility").isin("public", "global") | ((F.col("visibility") == "protected") & F.lit(below or inside)) | ((F.col("visibility") == "private") & F.lit(inside)))


def library_candidates(p: Program, class_name: str) -> DataFrame:
    """(name, arity) of a platform class's members, properties with arity -1."""
    return p.library.where(F.col("class_lc") == class_name.lower()).select(F.col("name_lc").alias("name"), "arity").distinct()


def expression_types(p: Program) -> DataFrame:
    """(path, start, end, type_text) of uses whose type as an expression is known."""
    return p.refs.select("rid", "path", "start", "end").distinct().join(p.result_types, "rid").select("path", "start", "end", "type_text")
