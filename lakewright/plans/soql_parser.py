"""Text of an object query or search to its syntax tree.

Names are case-insensitive. A chain of conditions may not mix AND and OR without
parentheses, and NOT stands before a single condition: both are ambiguous and
rejected rather than guessed.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from decimal import Decimal

from .soql_ast import Bind, Call, Compare, DateFormula, Fields, Geo, Item, Literal, Logic, Not, Order, Path, Query, QueryError, Returning, Search, Typeof, Values

AGGREGATES = {"count", "count_distinct", "sum", "avg", "min", "max"}
DATE_FUNCTIONS = set("calendar_year calendar_quarter calendar_month day_in_month day_in_week day_in_year day_only fiscal_year fiscal_quarter fiscal_month hour_in_day week_in_month week_in_year".split())
FUNCTIONS = AGGREGATES | DATE_FUNCTIONS | set("grouping tolabel format convertcurrency converttimezone distance".split())
_PLAIN = "yesterday today tomorrow last_90_days next_90_days".split()
_UNITS = "week month quarter year fiscal_quarter fiscal_year".split()
#: Formulas without a count, and formulas that take one after a colon.
FORMULAS = set(_PLAIN) | {f"{w}_{u}" for w in ("last", "this", "next") for u in _UNITS}
COUNTED = {"last_n_days", "next_n_days", "n_days_ago"} | {f"{w}_n_{u}s" for w in ("last", "next") for u in _UNITS} | {f"n_{u}s_ago" for u in _UNITS}

_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<mstring>'''.*?''')
    |(?P<string>'(?:\\.|[^'\\])*')
    |(?P<datetime>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))
    |(?P<date>\d{4}-\d{2}-\d{2}(?![\dT]))
    |(?P<time>\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))
    |(?P<currency>[A-Za-z]{3}\d+(?:\.\d+)?(?![\w]))
    |(?P<number>\d+(?:\.\d+)?|\.\d+)
    |(?P<braces>\{[^{}]*\})
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><=|>=|<>|!=|[=<>(),.:+\-\[\]])""",
    re.VERBOSE | re.DOTALL,
)


class _Reader:
    def __init__(self, text: str):
        self.text, self.toks, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.toks.append(("end", "", len(text)))
        self.i = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.toks[min(self.i + ahead, len(self.toks) - 1)]

    def next(self) -> tuple[str, str, int]:
        t = self.peek()
        self.i += 1
        return t

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        return all(self.peek(k)[0] in ("name", "op") and self.peek(k)[1].lower() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            kind, text, at = self.peek()
            raise QueryError(f"expected {' '.join(words).upper()} at {at}, found {text or kind!r}")

    def name(self, what: str) -> str:
        kind, text, at = self.next()
        if kind != "name":
            raise QueryError(f"expected {what} at {at}, found {text or kind!r}")
        return text


_CLAUSES = set("from where using with group having order limit offset all for update and or not when then else end asc desc nulls in like includes excludes returning find".split())


class _Parser(_Reader):
    # -- expressions -------------------------------------------------------
    def path(self) -> Path:
        parts = [self.name("a field")]
        while self.take("."):
            parts.append(self.name("a field"))
        return Path(tuple(parts))

    def operand(self):
        kind, text, at = self.peek()
        if kind == "name" and self.peek(1)[1] == "(":
            return self.call()
        if kind != "name":
            raise QueryError(f"expected a field at {at}, found {text or kind!r}")
        return self.path()

    def call(self):
        name, at = self.name("a function").lower(), self.peek()[2]
        self.need("(")
        if name == "fields":
            which = self.name("ALL, STANDARD or CUSTOM").lower()
            if which not in ("all", "standard", "custom"):
                raise QueryError(f"FIELDS takes ALL, STANDARD or CUSTOM, not {which!r}")
            self.need(")")
            return Fields(which)
        if name == "geolocation":
            lat = self.value()
            self.need(",")
            lon = self.value()
            self.need(")")
            return Geo(lat, lon)
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name!r} at {at}")
        args: list = []
        if not self.at(")"):
            while True:
                args.append(self.value() if self.peek()[0] in ("string", "op") else self.operand())
                if not self.take(","):
                    break
        self.need(")")
        want = {"count": (0, 1), "distance": (3, 3)}.get(name, (1, 1))
        if not want[0] <= len(args) <= want[1]:
            raise QueryError(f"{name.upper()} takes {want[1]} arguments")
        if name in AGGREGATES - {"count"} and isinstance(args[0], Call) and args[0].name in AGGREGATES:
            raise QueryError("aggregates do not nest")
        if any(isinstance(a, Call) and a.name == "converttimezone" for a in args) and name not in DATE_FUNCTIONS:
            raise QueryError("convertTimezone stands inside a date function only")
        return Call(name, tuple(args))

    def value(self):
        kind, text, at = self.next()
        low = text.lower()
        if kind == "string":
            return Literal("string", unquote(text[1:-1]))
        if kind == "mstring":
            return Literal("string", text[3:-3])
        if kind == "date":
            return Literal("date", date.fromisoformat(text))
        if kind == "datetime":
            return Literal("datetime", datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC).replace(tzinfo=None))
        if kind == "time":
            return Literal("time", text)
        if kind == "currency":
            return Literal("currency", (text[:3].upper(), Decimal(text[3:])))
        if kind == "number":
            return Literal("number", Decimal(text) if "." in text else int(text))
        if text in "+-" and self.peek()[0] == "number":
            v = self.value().value
            return Literal("number", -v if text == "-" else v)
        if text == ":":
            return Bind(self.bind_name())
        if text == "(":
            if self.at("select"):
                q = self.query(nested=True)
                self.need(")")
                return q
            items = [self.value()]
            while self.take(","):
                items.append(self.value())
            self.need(")")
            return Values(tuple(items))
        if kind == "name" and low == "null":
            return Literal("null", None)
        if kind == "name" and low in ("true", "false"):
            return Literal("boolean", low == "true")
        if kind == "name" and low == "geolocation":
            self.i -= 1
            return self.call()
        if kind == "name" and low in FORMULAS:
            return DateFormula(low)
        if kind == "name" and low in COUNTED:
            if not self.take(":"):
                raise QueryError(f"{low.upper()} needs a count, as in {low.upper()}:3")
            k, t, _ = self.next()
            if k != "number" or "." in t:
                raise QueryError(f"{low.upper()} needs a whole count")
            return DateFormula(low, int(t))
        if kind == "name" and re.fullmatch(r"[A-Za-z]{3}", text) and self.peek()[0] == "number":
            return Literal("currency", (text.upper(), Decimal(self.next()[1])))
        raise QueryError(f"expected a value at {at}, found {text or kind!r}")

    def bind_name(self) -> str:
        name = self.name("a bind name")
        while self.take("."):
            name += "." + self.name("a bind name")
        return name

    # -- conditions --------------------------------------------------------
    def condition(self):
        negated = self.take("not")
        items, op = [self.simple()], ""
        while self.at("and") or self.at("or"):
            word = self.next()[1].lower()
            if op and word != op:
                raise QueryError("AND and OR need parentheses when mixed")
            op = word
            if self.at("not"):
                raise QueryError("NOT needs parentheses inside a chain")
            items.append(self.simple())
        if negated and len(items) > 1:
            raise QueryError("NOT before a chain needs parentheses")
        out = items[0] if len(items) == 1 else Logic(op, tuple(items))
        return Not(out) if negated else out

    def simple(self):
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        left = self.operand()
        kind, text, at = self.next()
        op = text.lower()
        if op == "<>":
            op = "!="
        if op == "not":
            self.need("in")
            op = "not in"
        if op not in ("=", "!=", "<", "<=", ">", ">=", "like", "in", "not in", "includes", "excludes"):
            raise QueryError(f"expected a comparison at {at}, found {text or kind!r}")
        right = self.value()
        if isinstance(right, Query) and op not in ("in", "not in"):
            raise QueryError("a sub-query stands after IN or NOT IN only")
        return Compare(left, op, right)

    # -- clauses -----------------------------------------------------------
    def alias(self) -> str | None:
        if self.peek()[0] == "name" and self.peek()[1].lower() not in _CLAUSES:
            return self.next()[1]
        return None

    def item(self) -> Item:
        if self.take("("):
            q = self.query(nested=True)
            self.need(")")
            return Item(q)
        if self.at("typeof"):
            return Item(self.typeof())
        e = self.operand()
        return Item(e, None if isinstance(e, Fields) else self.alias())

    def typeof(self) -> Typeof:
        self.need("typeof")
        path, whens, other = self.path(), [], ()
        while self.take("when"):
            kind = self.name("an object")
            self.need("then")
            whens.append((kind, tuple(self.paths())))
        if not whens:
            raise QueryError("TYPEOF needs a WHEN")
        if self.take("else"):
            other = tuple(self.paths())
        self.need("end")
        return Typeof(path, tuple(whens), other)

    def paths(self) -> list[Path]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def count(self, what: str):
        kind, text, at = self.peek()
        v = self.value() if kind in ("number", "op") else None
        if isinstance(v, Bind) or isinstance(v, Literal) and isinstance(v.value, int) and v.value >= 0:
            return v
        raise QueryError(f"{what} needs a whole number or a bind at {at}")

    def orders(self) -> list[Order]:
        out = []
        while True:
            e, desc, nulls = self.operand(), False, None
            if self.take("desc"):
                desc = True
            else:
                self.take("asc")
            if self.take("nulls"):
                nulls = self.name("FIRST or LAST").lower()
                if nulls not in ("first", "last"):
                    raise QueryError("NULLS takes FIRST or LAST")
            out.append(Order(e, desc, nulls))
            if not self.take(","):
                return out

    def query(self, nested: bool = False) -> Query:
        self.need("select")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("from")
        q = Query(items, str(self.path()))
        self.take("as")
        q.alias = self.alias()
        while self.take(","):
            src = str(self.path())
            self.take("as")
            q.more_sources.append((src, self.alias()))
        if nested and (self.at("using") or self.at("with") or self.at("group") or self.at("offset")):
            raise QueryError(f"{self.peek()[1].upper()} is not allowed in a sub-query")
        if self.take("using"):
            self.take("scope")
            q.scope = self.name("a scope")
        if self.take("where"):
            q.where = self.condition()
        if not nested and self.take("with"):
            q.with_ = self.with_clause()
        if not nested and self.take("group", "by"):
            q.group_kind = "rollup" if self.at("rollup", "(") else "cube" if self.at("cube", "(") else "plain"
            if q.group_kind != "plain":
                self.i += 2
            q.groups = [self.operand()]
            while self.take(","):
                q.groups.append(self.operand())
            if q.group_kind != "plain":
                self.need(")")
            if self.take("having"):
                q.having = self.condition()
        if self.take("order", "by"):
            q.order = self.orders()
        if self.take("limit"):
            q.limit = self.count("LIMIT")
        if not nested and self.take("offset"):
            q.offset = self.count("OFFSET")
        if not nested and self.take("all", "rows"):
            q.all_rows = True
        while self.take("for"):
            q.for_.append(self.choice("FOR", ("view", "update", "reference")))
        if self.take("update"):
            q.update.append(self.choice("UPDATE", ("tracking", "viewstat")))
            while self.take(","):
                q.update.append(self.choice("UPDATE", ("tracking", "viewstat")))
        return q

    def choice(self, what: str, words: tuple[str, ...]) -> str:
        w = self.name(what).lower()
        if w not in words:
            raise QueryError(f"{what} takes {', '.join(words).upper()}, not {w!r}")
        return w

    def with_clause(self):
        for mode in ("security_enforced", "user_mode", "system_mode"):
            if self.take(mode):
                return mode
        if self.take("data", "category"):
            out = []
            while True:
                group = self.name("a category group")
                how = self.choice("DATA CATEGORY", ("at", "above", "below", "above_or_below"))
                if self.take("("):
                    names = [self.name("a category")]
                    while self.take(","):
                        names.append(self.name("a category"))
                    self.need(")")
                else:
                    names = [self.name("a category")]
                out.append((group, how, tuple(names)))
                if not self.take("and"):
                    return tuple(out)
        return self.condition()

    # -- searches ----------------------------------------------------------
    def search(self) -> Search:
        self.need("find")
        kind, text, at = self.next()
        if kind == "string":
            term: object = unquote(text[1:-1])
        elif kind == "braces":
            term = text[1:-1]
        elif text == ":":
            term = Bind(self.bind_name())
        else:
            raise QueryError(f"FIND needs a text at {at}")
        out = Search(term)
        if self.take("in"):
            out.fields = self.choice("IN", ("all", "email", "name", "phone", "sidebar"))
            self.need("fields")
        if self.take("returning"):
            out.returning = [self.returning()]
            while self.take(","):
                out.returning.append(self.returning())
        while self.take("with"):
            self.search_with(out)
        if self.take("limit"):
            out.limit = self.count("LIMIT")
        if self.take("update"):
            out.update.append(self.choice("UPDATE", ("tracking", "viewstat")))
        return out

    def returning(self) -> Returning:
        r = Returning(self.name("an object"))
        if self.take("("):
            r.items = [self.item()]
            while self.take(","):
                r.items.append(self.item())
            if any(isinstance(i.expr, Call) for i in r.items) and len(r.items) > 1:
                raise QueryError("a function stands alone in a RETURNING list")
            if self.take("where"):
                r.where = self.condition()
            if self.take("using"):
                self.need("listview", "=")
                r.listview = self.name("a list view")
            if self.take("order", "by"):
                r.order = self.orders()
            if self.take("limit"):
                r.limit = self.count("LIMIT")
            if self.take("offset"):
                r.offset = self.count("OFFSET")
            self.need(")")
        return r

    def search_with(self, out: Search) -> None:
        if self.at("data", "category"):
            out.with_["data_category"] = self.with_clause()
            return
        key = self.choice("WITH", ("division", "snippet", "network", "pricebookid", "metadata", "highlight", "user_mode", "system_mode", "spell_correction"))
        if key == "snippet":
            n = None
            if self.take("("):
                self.need("target_length", "=")
                n = self.value()
                self.need(")")
            out.with_[key] = n
        elif key in ("highlight", "user_mode", "system_mode"):
            out.with_[key] = True
        elif key == "network" and self.take("in"):
            out.with_[key] = self.value()
        else:
            self.need("=")
            out.with_[key] = self.value()


def unquote(body: str) -> str:
    """The text of a quoted literal's body."""
    signs = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else signs.get(m[1], m[1]), body, flags=re.DOTALL)


def _whole(text: str) -> _Parser:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    return _Parser(text)


def parse_query(text: str) -> Query:
    p = _whole(text)
    q = p.query()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r} at {p.peek()[2]}")
    return q


def parse_search(text: str) -> Search:
    p = _whole(text)
    s = p.search()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r} at {p.peek()[2]}")
    return s


def result_type(q: Query) -> str:
    """Integer for a lone COUNT(), AggregateResult rows for aggregates or groups,
    else records of the source."""
    calls = [i.expr for i in q.items if isinstance(i.expr, Call)]
    if len(q.items) == 1 and calls and calls[0].name == "count" and not calls[0].args and not q.groups:
        return "Integer"
    if q.groups or any(c.name in AGGREGATES for c in calls):
        return "List<AggregateResult>"
    return f"List<{q.source}>"
