"""Findings over a program's relations: anti-joins, intervals and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import lookup
from ..storage import cut
from .bind import Program
from .facts import relation
from .types import SCALARS, compatible

COLUMNS = ["path", "start", "end", "severity", "code", "message"]
# Annotations by which the platform calls a member, and Database methods that do DML or queries.
PLATFORM = "auraenabled future httpdelete httpget httppatch httppost httpput invocablemethod invocablevariable remoteaction".split()
DATABASE = "insert update upsert delete undelete merge query countquery getquerylocator".split()


def finding(df: DataFrame, severity: str, code: str, message) -> DataFrame:
    return df.select("path", "start", "end", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def syntax_errors(p: Program) -> DataFrame:
    e = relation(p.facts, "errors").withColumn("end", F.col("start") + 1)
    return finding(e, "error", "syntax", F.col("message"))


def dead_symbols(p: Program) -> DataFrame:
    """Members and locals that nothing refers to. Platform entry points, tests,
    overrides, and members that an interface asks for are never dead."""
    s = p.symbols.where("kind in ('Method','Field','Property','Constructor','LocalVar') and visibility in ('private','public')")
    notes = F.split("annotations", ",")
    spared = F.exists(notes, lambda a: a.isin("istest", "testsetup", *PLATFORM)) | F.array_contains(F.split("modifiers", " "), "testmethod") | F.array_contains(F.split("modifiers", " "), "override")
    tests = p.symbols.where(F.array_contains(F.split("annotations", ","), "istest")).select(F.col("id").alias("container_id"))
    used = p.refs.where("target_id is not null").select(F.col("target_id").alias("id")).distinct()
    required = p.closure.join(p.symbols.where("kind = 'Method' and visibility <> 'private'").select(F.col("container_id").alias("super"), "name_lc", "arity"), "super").select(F.col("sub").alias("container_id"), "name_lc", "arity").distinct()
    interfaces = p.types.where("kind = 'Interface'").select(F.col("id").alias("container_id"))
    out = s.where(~spared).join(used, "id", "left_anti").join(tests, "container_id", "left_anti").join(interfaces, "container_id", "left_anti")
    out = out.join(p.platform_members(), "id", "left_anti").select(*out.columns)
    keep = out.where("kind <> 'Method'").unionByName(out.where("kind = 'Method'").join(required, ["container_id", "name_lc", "arity"], "left_anti").select(out.columns))
    alone = p.symbols.where("kind = 'Constructor'").groupBy("container_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("container_id", F.lit("Constructor").alias("kind"))
    return keep.join(alone.where("kind is not null"), ["container_id", "kind"], "left_anti")


def dead_code(p: Program) -> DataFrame:
    d = dead_symbols(p).withColumn("start", F.col("name_start")).withColumn("end", F.col("name_end"))
    return finding(d, "hint", "dead", F.concat(F.lower("kind"), F.lit(" '"), F.col("name"), F.lit("' is never used")))


def unresolved(p: Program) -> DataFrame:
    u = p.refs.where("outcome = 'Unresolved' and kind in ('name','method','type') and coalesce(receiver, '') <> '?'")
    own = u.where("receiver is null or receiver = 'this'")
    return finding(own, "warning", "unresolved", F.concat(F.lit("cannot resolve '"), F.col("name"), F.lit("'")))


def unknown_schema(p: Program) -> DataFrame:
    u = p.refs.where("outcome = 'UnknownSchema'")
    what = F.when(F.col("kind") == "soql_object", F.concat(F.lit("unknown object '"), F.col("name"), F.lit("'"))).otherwise(F.concat(F.lit("unknown field '"), F.col("name"), F.lit("' on '"), F.col("receiver"), F.lit("'")))
    return finding(u, "warning", "schema", what)


def modifier_conflicts(p: Program) -> DataFrame:
    words = p.symbols.where("kind not in ('LocalVar','Parameter')").withColumn("end", F.col("name_end")).withColumn("start", F.col("name_start")).withColumn("w", F.filter(F.split("modifiers", " "), lambda x: x != ""))
    scopes = F.size(F.filter("w", lambda x: x.isin("private", "protected", "public", "global")))
    twice = finding(words.where(F.size("w") > F.size(F.array_distinct("w"))), "error", "modifier", F.lit("duplicate modifier"))
    many = finding(words.where((scopes > 1) & (F.size("w") == F.size(F.array_distinct("w")))), "error", "modifier", F.lit("more than one access modifier"))
    both = finding(words.where(F.array_contains("w", "static") & F.array_contains("w", "abstract")), "error", "modifier", F.lit("static and abstract exclude each other"))
    return twice.unionByName(many).unionByName(both)


def bulkification(p: Program) -> DataFrame:
    """DML, queries and Database calls inside a loop's body; a query in the
    header of a for-each loop runs once and is fine."""
    r = p.refs.where("in_loop")
    db = (F.col("kind") == "method") & (F.lower("receiver") == "database") & F.lower("name").isin(*DATABASE)
    hit = r.where(F.col("kind").isin("dml", "soql", "sosl") | db).dropDuplicates(["rid"])
    what = F.when(F.col("kind") == "dml", "DML").when(F.col("kind") == "soql", "a query").when(F.col("kind") == "sosl", "a search").otherwise("a Database call")
    return finding(hit, "warning", "bulk", F.concat(what, F.lit(" inside a loop")))


def missing_implementations(p: Program) -> DataFrame:
    """Concrete classes without a method that an interface or abstract class above asks for."""
    m = p.symbols.where("kind = 'Method'").select("container_id", "name", "name_lc", "arity", "modifiers", "has_body")
    holders = p.types.select(F.col("id").alias("super"), F.col("kind").alias("super_kind"))
    need = p.closure.join(holders, "super").join(m, F.col("super") == F.col("container_id"))
    need = need.where((F.col("super_kind") == "Interface") | F.array_contains(F.split("modifiers", " "), "abstract")).select("sub", "name", "name_lc", "arity").dropDuplicates(["sub", "name_lc", "arity"])
    concrete = p.types.where((F.col("kind") == "Class") & ~F.array_contains(F.split("modifiers", " "), "abstract")).select(F.col("id").alias("sub"))
    have = p.types.select(F.col("id").alias("sub"), F.col("id").alias("holder")).unionByName(p.closure.select("sub", F.col("super").alias("holder")))
    given = have.join(m.where("has_body"), F.col("holder") == F.col("container_id")).select("sub", "name_lc", "arity").distinct()
    gap = need.join(concrete, "sub").join(given, ["sub", "name_lc", "arity"], "left_anti")
    at = p.symbols.select(F.col("id").alias("sub"), "path", F.col("name_start").alias("start"), F.col("name_end").alias("end"))
    return finding(gap.join(at, "sub"), "error", "missing", F.concat(F.lit("method '"), F.col("name"), F.lit("' is not implemented")))


def unreachable(p: Program) -> DataFrame:
    return finding(relation(p.facts, "unreachable"), "warning", "unreachable", F.lit("unreachable code"))


def type_mismatches(p: Program) -> DataFrame:
    """Initialisers, returned values and arguments whose own type cannot become
    the declared one. What is not known for certain passes."""
    own = relation(p.facts, "mismatches").select("path", "start", "end", "message")
    given = relation(p.facts, "args")
    calls = p.refs.where("kind in ('method','new') and target_id is not null").select("path", F.col("start").alias("at"), "rid", F.col("target_id").alias("callee"))
    sure = calls.groupBy("path", "at").agg(F.countDistinct("callee").alias("n")).where("n = 1").select("path", "at")
    params = p.symbols.where("kind in ('Method','Constructor')").select(F.col("id").alias("callee"), F.posexplode(F.split("params", ";")).alias("k", "want"))
    # every pair of scalars that certainly does not fit: a fixed, small table
    bad = [(w, g) for w in sorted(SCALARS) for g in sorted(SCALARS) if compatible(w, g) is False]
    never = p.files.sparkSession.createDataFrame(bad, "want_lc string, got_lc string")
    j = lookup(cut(given.join(calls, ["path", "at"]).join(sure, ["path", "at"], "left_semi"), "args"), params, ["callee", "k"])
    j = j.join(F.broadcast(never), (F.lower("want") == F.col("want_lc")) & (F.lower("got") == F.col("got_lc")))
    first = j.groupBy("path", "at").agg(F.min(F.struct("k", "start", "end", F.concat("got", F.lit(" cannot become "), "want").alias("message"))).alias("m"))
    return finding(own.unionByName(first.select("path", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.message").alias("message"))), "error", "type", F.col("message"))


def type_narrowing(p: Program) -> DataFrame:
    """Nested public types that could be private: every use is inside the same
    top-level type, and no member that outsiders use has one in its signature."""
    s = p.symbols.where("kind in ('Class','Interface','Enum') and visibility = 'public' and container >= 0").drop("type_id", "top_id")
    top = p.owner.select("id", F.col("top_id").alias("own_top"))
    uses = p.refs.where("target_id is not null").select(F.col("target_id").alias("id"), "top_id", "within_id")
    j = s.join(top, "id").join(uses, "id")
    inside = j.groupBy("path", "id", "name", "name_start", "name_end").agg(F.every(F.col("top_id") == F.col("own_top")).alias("inside")).where("inside")
    outside = uses.join(top, "id").where("top_id <> own_top").select(F.col("id").alias("within_id")).distinct()
    members = p.symbols.where("kind in ('Method','Field','Property','Constructor')").select(F.col("id").alias("within_id"))
    leaks = p.refs.where("kind = 'type' and target_id is not null").join(members, "within_id", "left_semi").join(outside, "within_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    g = inside.join(leaks, "id", "left_anti").withColumn("start", F.col("name_start")).withColumn("end", F.col("name_end"))
    return finding(g, "hint", "narrow", F.concat(F.lit("type '"), F.col("name"), F.lit("' can be private")))


def narrowing(p: Program) -> DataFrame:
    """Public members that could be private or protected: every use is in the
    same top-level type, or in a subtype. Unused members are dead code instead."""
    spared = F.exists(F.split("annotations", ","), lambda a: a.isin("istest", "testsetup", "testvisible", *PLATFORM)) | F.array_contains(F.split("modifiers", " "), "override")
    s = p.symbols.where(F.col("kind").isin("Method", "Field", "Property") & (F.col("visibility") == "public") & ~spared).drop("type_id", "top_id")
    interfaces = p.types.where("kind = 'Interface'").select(F.col("id").alias("container_id"))
    required = p.closure.join(p.symbols.where("kind = 'Method' and visibility <> 'private'").select(F.col("container_id").alias("super"), "name_lc", "arity"), "super").select(F.col("sub").alias("container_id"), "name_lc", "arity").distinct()
    s = s.join(interfaces, "container_id", "left_anti").join(required, ["container_id", "name_lc", "arity"], "left_anti")
    top = p.owner.select("id", F.col("type_id").alias("own_type"), F.col("top_id").alias("own_top"))
    uses = p.refs.where("target_id is not null").select(F.col("target_id").alias("id"), "type_id", "top_id")
    sub = p.closure.select(F.col("sub").alias("type_id"), F.col("super").alias("own_type"), F.lit(True).alias("is_sub"))
    j = lookup(uses, s.join(top, "id"), ["id"]).join(sub, ["type_id", "own_type"], "left")
    g = j.groupBy("path", "id", "name", "name_start", "name_end").agg(F.every(F.col("top_id") == F.col("own_top")).alias("inside"), F.every((F.col("top_id") == F.col("own_top")) | F.coalesce("is_sub", F.lit(False))).alias("family"))
    g = g.where("family").withColumn("start", F.col("name_start")).withColumn("end", F.col("name_end"))
    members = finding(g, "hint", "narrow", F.concat(F.lit("'"), F.col("name"), F.lit("' can be "), F.when(F.col("inside"), "private").otherwise("protected")))
    return members.unionByName(type_narrowing(p))


CHECKS = (syntax_errors, dead_code, unresolved, unknown_schema, modifier_conflicts, bulkification, unreachable, missing_implementations, type_mismatches, narrowing)


def all_findings(p: Program) -> DataFrame:
    """Every finding of every check."""
    return reduce(DataFrame.unionByName, (c(p) for c in CHECKS))


def dead_code_fixes(p: Program) -> DataFrame:
    """(path, start, end, new_text, status): deletions of dead declarations,
    the outermost of nested ones. Of a declaration with several declarators the dead
    ones go alone, with a comma; the whole goes when all are dead."""
    dead = dead_symbols(p).where("kind in ('Method','Field','Property','LocalVar')").select("id", F.lit(True).alias("dead"))
    w = Window.partitionBy("path", "start", "end").orderBy("decl_start")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = p.symbols.where("kind in ('Method','Field','Property','LocalVar')").join(dead, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    s = s.withColumn("alive_before", F.sum((~F.col("dead")).cast("int")).over(w)).withColumn("alive", F.sum((~F.col("dead")).cast("int")).over(every))
    s = s.withColumn("prev_end", F.lag("decl_end").over(w)).withColumn("next_start", F.lead("decl_start").over(w)).where("dead")
    part = (F.col("declarators") > 1) & (F.col("alive") > 0)
    lo = F.when(part & (F.col("alive_before") == 0), F.col("decl_start")).when(part, F.col("prev_end")).otherwise(F.col("start"))
    hi = F.when(part & (F.col("alive_before") == 0), F.col("next_start")).when(part, F.col("decl_end")).otherwise(F.col("end"))
    d = s.select("path", lo.alias("start"), hi.alias("end")).distinct()
    w = Window.partitionBy("path").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("m", F.max("end").over(w))
    return d.select("path", "start", "end", F.lit("").alias("new_text"), F.when(F.col("m") >= F.col("end"), "subsumed").otherwise("apply").alias("status"))


def unresolved_kinds(p: Program) -> DataFrame:
    """(path, start, end, why) of unresolved uses: an unknown name, a member that a
    known receiver lacks, or a receiver whose type is not known."""
    u = p.refs.where("outcome = 'Unresolved'")
    why = F.when(F.col("receiver").isNull(), "unknown name").when(F.col("receiver") == "?", "receiver of unknown type").otherwise("no such member")
    return u.select("path", "start", "end", why.alias("why"))


def located(p: Program) -> DataFrame:
    """All findings with 1-based line and column (in bytes) instead of offsets."""
    from ..operators.relations import line_col, line_table

    points = all_findings(p).withColumnRenamed("start", "offset")
    return line_col(points, line_table(p.files, "path", "text"), "path").select("path", "line", "col", "severity", "code", "message")
