"""Syntax trees of queries to DataFrame plans.

Parent paths become left joins, one per path prefix however often it is named;
sub-queries become semi and null-aware anti joins; child queries are grouped by
their lookup before they are joined. Conditions stay plain column predicates, so
that those on the source reach its scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalogue import Catalogue, Entity
from .dates import interval
from .soql_ast import Bind, Call, Compare, DateFormula, Fields, Geo, Item, Literal, Logic, Not, Path, Query, QueryError, Typeof, Values
from .soql_parser import AGGREGATES, DATE_FUNCTIONS, parse_query, result_type

EARTH = {"mi": 3958.756, "km": 6371.0}


@dataclass
class Semantics:
    """What the language leaves to its host."""

    as_of: date = date(2000, 1, 1)
    week_start: int = 6  # Sunday
    fiscal_start: int = 1
    nulls_first: bool = True
    ignore_case: bool = False  # = and != on texts; LIKE always ignores case
    timezone: str = "UTC"
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    rates: dict[str, float] = field(default_factory=dict)
    categories: dict[str, dict[str, str]] = field(default_factory=dict)  # group -> child -> parent


class Scope:
    """One source, its joined parents, and the columns that paths resolve to."""

    def __init__(self, cat: Catalogue, entity: Entity, aliases: set[str], tag: str = "t"):
        self.cat, self.entity, self.aliases, self.tag = cat, entity, {a.lower() for a in aliases if a}, tag
        self.hops: dict[tuple[str, ...], tuple[Entity, str]] = {}
        self.df = self._renamed(entity, tag)
        self.n = 0
        self.hops[()] = (entity, tag)

    def _renamed(self, e: Entity, tag: str) -> DataFrame:
        df = self.cat.frame(e)
        return df.select(*(F.col(f"`{c}`").alias(f"{tag}__{c}") for c in df.columns))

    def columns(self, e: Entity) -> list[str]:
        return self.cat.frame(e).columns

    def column(self, path: Path) -> Column:
        parts = list(path.parts)
        if len(parts) > 1 and parts[0].lower() in self.aliases:
            parts = parts[1:]
        entity, tag = self.hop(tuple(parts[:-1]))
        name = self.cat.field(self.columns(entity), parts[-1]) or (entity.id_fields[0] if parts[-1].lower() == "id" else None)
        if name is None:
            raise QueryError(f"no field {parts[-1]!r} on {entity.name}")
        return F.col(f"`{tag}__{name}`")

    def hop(self, parts: tuple[str, ...]) -> tuple[Entity, str]:
        key = tuple(p.lower() for p in parts)
        if key in self.hops:
            return self.hops[key]
        entity, tag = self.hop(parts[:-1])
        link = self.cat.lookup(entity, parts[-1])
        if link is None:
            raise QueryError(f"no relationship {parts[-1]!r} on {entity.name}")
        if len(link.targets) > 1:
            raise QueryError(f"{parts[-1]} has several kinds of target; use TYPEOF")
        self.hops[key] = self.join(entity, tag, link.field, link.targets[0], None, None)
        return self.hops[key]

    def join(self, entity: Entity, tag: str, by: str, target: str, type_field: str | None, kind: str | None) -> tuple[Entity, str]:
        parent = self.cat.get(target)
        if parent is None:
            raise QueryError(f"unknown object {target!r}")
        if len(parent.id_fields) > 1:
            raise QueryError(f"{parent.name} has an id of several fields, which {by} does not name")
        self.n += 1
        new = f"{self.tag}{self.n}"
        on = F.col(f"`{tag}__{by}`") == F.col(f"`{new}__{parent.id_fields[0]}`")
        if type_field:
            on &= F.col(f"`{tag}__{type_field}`") == kind
        self.df = self.df.join(self._renamed(parent, new), on, "left")
        return parent, new


class Compiler:
    def __init__(self, cat: Catalogue, semantics: Semantics | None = None, binds: dict | None = None):
        self.cat, self.sem = cat, semantics or Semantics()
        self.binds = {k.lower(): v for k, v in (binds or {}).items()}
        self.warnings: list[str] = []

    # -- values ------------------------------------------------------------
    def bind(self, name: str):
        if name.lower() not in self.binds:
            raise QueryError(f"no value bound to :{name}")
        return self.binds[name.lower()]

    def literal(self, v) -> Column:
        if isinstance(v, Bind):
            got = self.bind(v.name)
            return F.array(*(F.lit(x) for x in got)) if isinstance(got, (list, tuple, set)) else F.lit(got)
        if isinstance(v, Literal):
            if v.kind == "date":
                return F.lit(v.value)
            if v.kind == "datetime":
                return F.to_timestamp_ntz(F.lit(v.value.isoformat(sep=" ")))
            if v.kind == "currency":
                return F.lit(v.value[1])
            return F.lit(v.value)
        raise QueryError(f"not a single value: {v}")

    def several(self, v) -> list:
        if isinstance(v, Values):
            return [x for i in v.items for x in self.several(i)]
        if isinstance(v, Bind):
            got = self.bind(v.name)
            return [F.lit(x) for x in got] if isinstance(got, (list, tuple, set)) else [F.lit(got)]
        return [self.literal(v)]

    # -- scalar functions --------------------------------------------------
    def scalar(self, c: Call, s: Scope) -> Column:
        if c.name == "distance":
            return self.distance(c, s)
        x = self.expr(c.args[0], s)
        if c.name in DATE_FUNCTIONS:
            return self.date_part(c.name, x)
        if c.name == "converttimezone":
            return F.convert_timezone(F.lit("UTC"), F.lit(self.sem.timezone), x)
        if c.name == "tolabel":
            labels = self.sem.labels.get(str(c.args[0]).lower(), {})
            return reduce(lambda acc, kv: acc.when(x == kv[0], kv[1]), labels.items(), F.when(F.lit(False), F.lit(""))).otherwise(x) if labels else x
        if c.name == "convertcurrency":
            return x * self.sem.rates.get(str(c.args[0]).lower(), 1)
        if c.name == "format":
            return x.cast("string")
        if c.name == "grouping":
            return F.grouping(x)
        raise QueryError(f"{c.name.upper()} cannot stand here")

    def date_part(self, name: str, x: Column) -> Column:
        fiscal = F.add_months(F.to_date(x), 1 - self.sem.fiscal_start)
        return {
            "calendar_year": lambda: F.year(x),
            "calendar_quarter": lambda: F.quarter(x),
            "calendar_month": lambda: F.month(x),
            "day_in_month": lambda: F.dayofmonth(x),
            "day_in_week": lambda: F.dayofweek(x),
            "day_in_year": lambda: F.dayofyear(x),
            "day_only": lambda: F.to_date(x),
            "fiscal_year": lambda: F.year(fiscal),
            "fiscal_quarter": lambda: F.quarter(fiscal),
            "fiscal_month": lambda: F.month(fiscal),
            "hour_in_day": lambda: F.hour(x),
            "week_in_month": lambda: F.ceil(F.dayofmonth(x) / 7).cast("int"),
            "week_in_year": lambda: F.ceil(F.dayofyear(x) / 7).cast("int"),
        }[name]()

    def distance(self, c: Call, s: Scope) -> Column:
        def point(a) -> tuple[Column, Column]:
            if isinstance(a, Geo):
                return self.literal(a.lat).cast("double"), self.literal(a.lon).cast("double")
            if isinstance(a, Bind):
                lat, lon = self.bind(a.name)
                return F.lit(float(lat)), F.lit(float(lon))
            at = self.expr(a, s)
            return at["lat"], at["lon"]

        unit = c.args[2]
        if not isinstance(unit, Literal) or unit.value not in EARTH:
            raise QueryError("DISTANCE takes 'mi' or 'km'")
        (a, b), (p, q) = point(c.args[0]), point(c.args[1])
        h = F.pow(F.sin(F.radians(p - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(p)) * F.pow(F.sin(F.radians(q - b) / 2), 2)
        return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * EARTH[unit.value]

    def expr(self, e, s: Scope) -> Column:
        if isinstance(e, Path):
            return s.column(e)
        if isinstance(e, Call):
            return self.scalar(e, s)
        return self.literal(e)

    def aggregate(self, c: Call, s: Scope) -> Column:
        if not c.args:
            return F.count(F.lit(1))
        x = self.expr(c.args[0], s)
        if c.name == "avg":
            return F.sum(x).cast("double") / F.count(x)
        return {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max}[c.name](x)

    # -- conditions --------------------------------------------------------
    def predicate(self, c, value) -> Column:
        """value(expr) gives the column of a left side."""
        if isinstance(c, Logic):
            parts = [self.predicate(i, value) for i in c.items]
            return reduce((lambda a, b: a & b) if c.op == "and" else (lambda a, b: a | b), parts)
        if isinstance(c, Not):
            return ~self.predicate(c.item, value)
        left, op, right = value(c.left), c.op, c.right
        if isinstance(right, Query):
            raise QueryError("a sub-query stands at the top of WHERE, joined by AND")
        if isinstance(right, DateFormula):
            lo, hi = (F.lit(d) for d in interval(right, self.sem.as_of, self.sem.week_start, self.sem.fiscal_start))
            return {"=": (left >= lo) & (left < hi), "!=": (left < lo) | (left >= hi), "<": left < lo, "<=": left < hi, ">": left >= hi, ">=": left >= lo}[op]
        if isinstance(right, Literal) and right.kind == "null":
            if op not in ("=", "!="):
                raise QueryError("null compares by = and != only")
            return left.isNull() if op == "=" else left.isNotNull()
        if op in ("in", "not in"):
            got = left.isin(*self.several(right))
            return got if op == "in" else ~got
        if op in ("includes", "excludes"):
            own = F.split(left, ";")
            each = [F.forall(F.split(v, ";"), lambda x: F.array_contains(own, x)) for v in self.several(right)]
            got = reduce(lambda a, b: a | b, each)
            return got if op == "includes" else ~got
        if op == "like":
            got = right.value if isinstance(right, Literal) else self.bind(right.name)
            return reduce(lambda a, b: a | b, (left.ilike(str(g)) for g in (got if isinstance(got, (list, tuple, set)) else (got,))))
        v = self.literal(right)
        if self.sem.ignore_case and isinstance(right, (Literal, Bind)) and isinstance(right.value if isinstance(right, Literal) else self.bind(right.name), str):
            left, v = F.lower(left.cast("string")), F.lower(v)
        return {"=": left == v, "!=": left != v, "<": left < v, "<=": left <= v, ">": left > v, ">=": left >= v}[op]

    def where(self, s: Scope, cond, aliases: dict | None = None) -> None:
        """Filter a scope; sub-queries under AND become joins."""
        if cond is None:
            return
        parts = cond.items if isinstance(cond, Logic) and cond.op == "and" else (cond,)
        plain = [p for p in parts if not (isinstance(p, Compare) and isinstance(p.right, Query))]
        tests = [self.predicate(p, lambda e: self.expr(e, s)) for p in plain]
        if tests:
            s.df = s.df.filter(reduce(lambda a, b: a & b, tests))
        for p in parts:
            if p in plain:
                continue
            key = self.expr(p.left, s)
            sub = self.rows(p.right, "s")
            if len(sub.columns) != 1:
                raise QueryError("a sub-query after IN selects one field")
            inner = sub.select(F.col(f"`{sub.columns[0]}`").alias("__in")).distinct()
            s.df = s.df.withColumn("__key", key)
            if p.op == "in":
                s.df = s.df.join(inner, F.col("__key") == F.col("__in"), "left_semi")
            else:
                # NOT IN is null-aware: a null on either side leaves no row, but
                # every row stays if there is nothing to compare with
                nulls = inner.where("__in is null").limit(1).select(F.lit(1).alias("__n"))
                some = inner.limit(1).select(F.lit(1).alias("__n"))
                kept = s.df.where("__key is not null").join(inner.where("__in is not null"), F.col("__key") == F.col("__in"), "left_anti").join(nulls, F.lit(True), "left_anti")
                s.df = kept.unionByName(s.df.where("__key is null").join(some, F.lit(True), "left_anti"))
            s.df = s.df.drop("__key")

    # -- queries -----------------------------------------------------------
    def scope(self, q: Query, tag: str = "t") -> Scope:
        entity = self.cat.get(q.source)
        if entity is None:
            raise QueryError(f"unknown object {q.source!r}")
        s = Scope(self.cat, entity, {q.alias, q.source}, tag)
        for src, alias in q.more_sources:
            parts = src.split(".")
            if parts[0].lower() not in s.aliases:
                raise QueryError(f"FROM {src}: only paths of the first source may follow it")
            got = s.hop(tuple(parts[1:]))
            s.hops[((alias or parts[-1]).lower(),)] = got
        if entity.deleted and not q.all_rows:
            s.df = s.df.filter(~F.col(f"`{tag}__{entity.deleted}`"))
        if q.scope:
            if q.scope.lower() not in entity.scopes:
                raise QueryError(f"unknown scope {q.scope!r} of {entity.name}")
            s.df = s.df.filter(entity.scopes[q.scope.lower()](s.df))
        for what in (*q.for_, *q.update):
            self.warnings.append(f"{what.upper()} has no effect here")
        return s

    def compile(self, q: Query) -> DataFrame:
        return self.rows(q, "t")

    def rows(self, q: Query, tag: str) -> DataFrame:
        s = self.scope(q, tag)
        kind = result_type(q)
        # joins come first, so that every path of the query is known to the plan
        if kind == "Integer" or kind == "List<AggregateResult>":
            return self.grouped(q, s)
        out: list[Column] = []
        names: set[str] = set()

        def add(c: Column, name: str) -> None:
            while name.lower() in names:
                name += "_"
            names.add(name.lower())
            out.append(c.alias(name))

        children = []
        for i in q.items:
            e = i.expr
            if isinstance(e, Fields):
                for c in s.columns(s.entity):
                    custom = c in s.entity.custom
                    if e.which == "all" or (e.which == "custom") == custom:
                        add(F.col(f"`{tag}__{c}`"), c)
            elif isinstance(e, Query):
                children.append((i, e))
            elif isinstance(e, Typeof):
                add(self.typeof(e, s), i.alias or e.path.parts[-1])
            else:
                add(self.expr(e, s), i.alias or self.default_name(e))
        orders = [self.order(o, self.expr(o.expr, s)) for o in q.order]
        self.where(s, q.where)
        self.with_(q, s)
        for k, (i, child) in enumerate(children):
            name = i.alias or child.source
            s.df, col = self.child(s, child, f"{tag}c{k}_")
            add(col, name)
        df = s.df
        df = self.sliced(q, df.orderBy(*orders) if orders else df)
        return df.select(*out)

    @staticmethod
    def default_name(e) -> str:
        if isinstance(e, Path):
            return e.parts[-1]
        return e.name

    def order(self, o, col: Column) -> Column:
        first = o.nulls == "first" if o.nulls else self.sem.nulls_first != o.descending
        if o.descending:
            return col.desc_nulls_first() if first else col.desc_nulls_last()
        return col.asc_nulls_first() if first else col.asc_nulls_last()

    def sliced(self, q: Query, df: DataFrame) -> DataFrame:
        skip, most = (self.bind(v.name) if isinstance(v, Bind) else v.value if v else None for v in (q.offset, q.limit))
        if skip:
            df = df.offset(int(skip))
        return df if most is None else df.limit(int(most))

    def with_(self, q: Query, s: Scope) -> None:
        w = q.with_
        if w is None or isinstance(w, str):
            return
        if isinstance(w, tuple):
            for group, how, names in w:
                s.df = s.df.filter(self.category(s, group, how, names))
            return
        self.where(s, w)

    def category(self, s: Scope, group: str, how: str, names: tuple[str, ...]) -> Column:
        """A field named as the group holds a category; parents come from the semantics."""
        parent = {k.lower(): v.lower() for k, v in self.sem.categories.get(group.lower(), {}).items()}
        wanted: set[str] = set()
        for n in (x.lower() for x in names):
            up, at = [], n
            while at in parent and parent[at] not in up:
                at = parent[at]
                up.append(at)
            down, grown = {n}, True
            while grown:
                more = {k for k, v in parent.items() if v in down} - down
                down |= more
                grown = bool(more)
            wanted |= {"at": {n}, "above": set(up), "below": down - {n}, "above_or_below": set(up) | down}[how]
        return F.lower(s.column(Path((group,)))).isin(*sorted(wanted)) if wanted else F.lit(False)

    def typeof(self, e: Typeof, s: Scope) -> Column:
        """A struct of the type's name and every field that a branch names."""
        entity, tag = s.hop(e.path.parts[:-1])
        link = self.cat.lookup(entity, e.path.parts[-1])
        if link is None:
            raise QueryError(f"no relationship {e.path.parts[-1]!r} on {entity.name}")
        kind = F.col(f"`{tag}__{link.type_field}`") if link.type_field else F.lit(link.targets[0])
        got: dict[str, Column] = {}

        def take(target: str, paths, must: bool) -> set[str]:
            parent, new = s.join(entity, tag, link.field, target, link.type_field, target)
            found = set()
            for p in paths:
                name = self.cat.field(s.columns(parent), p.parts[-1])
                if name is None:
                    if must:
                        raise QueryError(f"no field {p} on {parent.name}")
                    continue
                found.add(p.parts[-1].lower())
                c = F.col(f"`{new}__{name}`").cast("string")
                old = got.get(name)
                got[name] = c if old is None else F.coalesce(old, c)
            return found

        named = {t.lower(): t for t in link.targets}
        for target, paths in e.whens:
            if target.lower() not in named:
                raise QueryError(f"{e.path} never refers to {target}")
            take(named[target.lower()], paths, True)
        if e.otherwise:
            # the other kinds of target give the fields of ELSE that they have
            rest = [t for t in link.targets if t.lower() not in {w.lower() for w, _ in e.whens}]
            found = set().union(*(take(t, e.otherwise, False) for t in rest))
            for p in e.otherwise:
                if rest and p.parts[-1].lower() not in found:
                    raise QueryError(f"no field {p} on {', '.join(rest)}")
                if not rest:
                    got.setdefault(p.parts[-1], F.lit(None).cast("string"))
        return F.struct(kind.alias("type"), *(c.alias(n) for n, c in got.items()))

    def child(self, s: Scope, q: Query, tag: str) -> tuple[DataFrame, Column]:
        """Rows of a child relation as an ordered array, grouped before the join."""
        link = self.cat.child(s.entity, q.source)
        if link is None:
            raise QueryError(f"no child relationship {q.source!r} on {s.entity.name}")
        if len(s.entity.id_fields) > 1:
            raise QueryError(f"{s.entity.name} has an id of several fields, which {q.source} does not name")
        inner = self.scope(Query(q.items, link[0], q.alias, all_rows=q.all_rows, for_=q.for_, update=q.update, scope=q.scope), tag)
        items = [(self.expr(i.expr, inner), i.alias or self.default_name(i.expr)) for i in q.items]
        orders = [self.order(o, self.expr(o.expr, inner)) for o in q.order]
        self.where(inner, q.where)
        self.with_(q, inner)
        fk = F.col(f"`{tag}__{link[1]}`")
        ids = self.cat.get(link[0]).id_fields
        ties = [F.col(f"`{tag}__{c}`") for c in ids]
        rows = inner.df.select(fk.alias("__fk"), F.row_number().over(Window.partitionBy(fk).orderBy(*orders, *ties)).alias("__rn"), F.struct(*(c.alias(n) for c, n in items)).alias("__row"))
        if q.limit is not None:
            most = self.bind(q.limit.name) if isinstance(q.limit, Bind) else q.limit.value
            rows = rows.where(F.col("__rn") <= most)
        grouped = rows.groupBy("__fk").agg(F.array_sort(F.collect_list(F.struct("__rn", "__row"))).alias("__rows"))
        key, name = f"{tag}_key", f"{tag}_rows"
        grouped = grouped.select(F.col("__fk").alias(key), F.transform("__rows", lambda r: r["__row"]).alias(name))
        own = F.col(f"`{s.tag}__{s.entity.id_fields[0]}`")
        df = s.df.join(grouped, own == F.col(key), "left").drop(key)
        empty = F.array().cast(grouped.schema[name].dataType)
        return df, F.coalesce(F.col(name), empty)

    def grouped(self, q: Query, s: Scope) -> DataFrame:
        alias_of = {i.alias.lower(): i.expr for i in q.items if i.alias}
        keys = {}
        for g in q.groups:
            e = alias_of.get(g.parts[0].lower(), g) if isinstance(g, Path) and len(g.parts) == 1 and self.cat.field(s.columns(s.entity), g.parts[0]) is None else g
            keys[self.key(e)] = self.expr(e, s)
        names = {k: f"__g{i}" for i, k in enumerate(keys)}
        aggs: dict[str, tuple[str, Column]] = {}

        def value(e) -> Column:
            if isinstance(e, Path) and len(e.parts) == 1 and e.parts[0].lower() in alias_of and self.key(e) not in names:
                e = alias_of[e.parts[0].lower()]
            k = self.key(e)
            if k in names:
                return F.col(names[k])
            if isinstance(e, Call) and e.name == "grouping":
                inner = self.key(e.args[0])
                if inner not in names:
                    raise QueryError(f"GROUPING({e.args[0]}) is not a group")
                if q.group_kind == "plain":
                    raise QueryError("GROUPING needs ROLLUP or CUBE")
                aggs.setdefault(k, (f"__a{len(aggs)}", F.grouping(names[inner])))
            elif isinstance(e, Call) and e.name in AGGREGATES:
                aggs.setdefault(k, (f"__a{len(aggs)}", self.aggregate(e, s)))
            elif isinstance(e, Call) and len(e.args) == 1 and isinstance(e.args[0], Call) and e.args[0].name in AGGREGATES and e.name in ("format", "convertcurrency"):
                return value(e.args[0]).cast("string") if e.name == "format" else value(e.args[0])
            else:
                raise QueryError(f"{k} is neither grouped nor aggregated")
            return F.col(aggs[k][0])

        out, unnamed = [], 0
        for i in q.items:
            if isinstance(i.expr, (Query, Typeof, Fields)):
                raise QueryError("a grouped query selects groups and aggregates only")
            name = i.alias
            if not name:
                if isinstance(i.expr, Path):
                    name = i.expr.parts[-1]
                else:
                    name = f"expr{unnamed}"
                    unnamed += 1
            out.append(value(i.expr).alias(name))
        having = self.predicate(q.having, value) if q.having is not None else None
        orders = [self.order(o, value(o.expr)) for o in q.order]
        self.where(s, q.where)
        self.with_(q, s)
        df = s.df
        for k, c in keys.items():
            df = df.withColumn(names[k], c)
        cols = list(names.values())
        by = df.rollup(*cols) if q.group_kind == "rollup" else df.cube(*cols) if q.group_kind == "cube" else df.groupBy(*cols)
        todo = [c.alias(n) for n, c in aggs.values()]
        res = by.agg(*todo) if todo else by.agg(F.count(F.lit(1)).alias("__n"))
        if having is not None:
            res = res.filter(having)
        if orders:
            res = res.orderBy(*orders)
        return self.sliced(q, res).select(*out)

    def key(self, e) -> str:
        if isinstance(e, Path):
            return ".".join(p.lower() for p in e.parts)
        if isinstance(e, Call):
            return f"{e.name}({','.join(self.key(a) for a in e.args)})"
        return repr(e)


def soql(cat: Catalogue, text: str, binds: dict | None = None, semantics: Semantics | None = None) -> DataFrame:
    """The rows of an object query."""
    return Compiler(cat, semantics, binds).compile(parse_query(text))


def soql_count(cat: Catalogue, text: str, binds: dict | None = None, semantics: Semantics | None = None) -> int:
    """The scalar of a lone COUNT() query."""
    return int(soql(cat, text, binds, semantics).first()[0])


__all__ = ["Compiler", "Item", "Semantics", "soql", "soql_count"]
