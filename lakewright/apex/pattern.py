"""Structural patterns: source code with holes, matched against trees.

`...` stands for any code, `$X` for one construct, `$...X` for a run, `$_` for
one construct that is not kept, `${X}` numbers a group, `^X` marks the place that
is reported. A match yields bindings; matching tries every way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.text import PatternError, flagged_regex, glob_parts
from .lexer import COMMENTS, Token
from .parser import Node, Tree, parse_fragment

FRAGMENTS = ("Expression", "Statement", "Block", "CatchClause", "ClassMember", "TypeDecl", "TriggerUnit", "SoqlBind")
RUNS = {"PatternHole", "PatternSeqCapture"}


@dataclass(frozen=True)
class Span:
    text: str
    start: int
    end: int


Binds = dict[str, Span]


def bare(x):
    """The token that alone makes up x, or None."""
    while isinstance(x, Node):
        if len(x.children) != 1 or x.kind in ("PatternFocus", "PatternGroup"):
            return None
        x = x.children[0]
    return x


def is_run(x) -> bool:
    t = bare(x)
    return t is not None and t.kind in RUNS


def is_comma(x) -> bool:
    return isinstance(x, Token) and x.text == ","


class Matcher:
    def __init__(self, text: str):
        self.text = text

    def span(self, x) -> Span:
        return Span(self.text[x.start: x.end], x.start, x.end)

    def bind(self, name: str, at: Span, binds: Binds) -> Iterator[Binds]:
        if name == "_":
            yield binds
        elif name in binds:
            if binds[name].text.lower() == at.text.lower():
                yield binds
        else:
            yield binds | {name: at}

    def element(self, p, s, binds: Binds) -> Iterator[Binds]:
        if isinstance(p, Node) and p.kind == "PatternFocus":
            for b in self.element(p.children[1], s, binds):
                yield b | {"^": Span("", s.start, s.start)}
            return
        if isinstance(p, Node) and p.kind == "PatternGroup":
            inner = p.children[1]
            for b in self.element(inner, s, binds):
                yield b | {f"#{p.children[0].start}": self.span(s)}
            return
        hole = bare(p)
        if hole is not None and hole.kind == "PatternCapture":
            if isinstance(s, Token) and s.kind == "Op" and s.text in ",;(){}[]":
                return
            if isinstance(p, Node) and p.kind == "Type" and isinstance(s, Node) and s.kind != "Type":
                return
            yield from self.bind(hole.text[1:], self.span(s), binds)
            return
        if hole is not None and hole.kind in RUNS:
            yield from self.bind(hole.text[4:] or "_", self.span(s), binds)
            return
        if isinstance(p, Token):
            if isinstance(s, Node):
                s = bare(s)
            if s is not None and self.same(p, s):
                yield binds
            return
        while isinstance(s, Node) and s.kind == "ParenExpr" and p.kind != "ParenExpr":
            s = s.children[1]
        if isinstance(s, Node):
            yield from self.node(p, s, binds)

    @staticmethod
    def same(p: Token, s: Token) -> bool:
        if p.kind == "StringLiteral":
            return s.kind in ("StringLiteral", "MultilineStringLiteral") and (p.text == "'...'" or p.text == s.text)
        return p.text.lower() == s.text.lower()

    @staticmethod
    def kinds(p: Node, s: Node) -> bool:
        if p.kind == s.kind:
            return True
        if {p.kind, s.kind} == {"ForStmt", "ForEachStmt"}:
            return any(isinstance(c, Token) and c.kind == "PatternHole" for c in p.children)
        if p.kind == "ConstructorDecl" and s.kind == "MethodDecl":
            return True
        braces = {"SetInitializer", "MapInitializer", "ArrayInitializer"}
        return p.kind in braces and s.kind in braces and all(not isinstance(c, Node) or is_run(c) for c in p.children)

    def node(self, p: Node, s: Node, binds: Binds) -> Iterator[Binds]:
        if not self.kinds(p, s):
            return
        pc, sc = p.children, s.children
        mods = {"Modifier", "Annotation"}
        pm = [c for c in pc if isinstance(c, Node) and c.kind in mods]
        sm = [c for c in sc if isinstance(c, Node) and c.kind in mods]
        if sm or pm:
            pc = [c for c in pc if c not in pm]
            sc = [c for c in sc if c not in sm]
        if p.kind in ("ForStmt", "ForEachStmt") and any(isinstance(c, Token) and c.kind == "PatternHole" for c in pc):
            # a hole header stands for either form's whole header
            pc, sc = pc[3:], sc[self.close(sc):]
        if p.kind == "ConstructorDecl" and s.kind == "MethodDecl":
            sc = [c for c in sc if not (isinstance(c, Node) and c.kind == "Type")]
        for b in self.subset(pm, sm, binds):
            found = False
            for got in self.seq(pc, sc, b):
                found = True
                yield got
            if p.kind == "Block" and s.kind == "Block" and not found:
                plan = self.deep(pc[1:-1])
                if plan:
                    cands = [n for c in sc[1:-1] if isinstance(c, Node) for n in c.walk()]
                    yield from self.ordered(plan, cands, 0, b)

    @staticmethod
    def close(sc: list) -> int:
        return next(i for i, c in enumerate(sc) if isinstance(c, Token) and c.text == ")")

    def subset(self, pm: list, sm: list, binds: Binds) -> Iterator[Binds]:
        if not pm:
            yield binds
            return
        for s in sm:
            for b in self.seq(pm[0].children, s.children, binds):
                yield from self.subset(pm[1:], sm, b)

    @staticmethod
    def deep(items: list) -> list | None:
        """The fixed elements of [..., P, ..., Q, ...], else None."""
        if len(items) < 3 or len(items) % 2 == 0 or not all(is_run(x) == (i % 2 == 0) for i, x in enumerate(items)):
            return None
        return items[1::2]

    def ordered(self, plan: list, cands: list, at: int, binds: Binds) -> Iterator[Binds]:
        if not plan:
            yield binds
            return
        for i in range(at, len(cands)):
            for b in self.element(plan[0], cands[i], binds):
                yield from self.ordered(plan[1:], cands, i + 1, b)

    def seq(self, ps: list, ss: list, binds: Binds) -> Iterator[Binds]:
        if not ps:
            if not ss:
                yield binds
            return
        p = ps[0]
        if is_run(p):
            hole = bare(p)
            name = hole.text[4:] or "_"
            for k in range(len(ss) + 1):
                rest = ps[1:]
                run = Span(self.text[ss[0].start: ss[k - 1].end], ss[0].start, ss[k - 1].end) if k else Span("", -1, -1)
                for b in self.bind(name, run, binds):
                    yield from self.seq(rest, ss[k:], b)
                    if k == 0 and rest and is_comma(rest[0]):
                        yield from self.seq(rest[1:], ss, b)
            return
        if is_comma(p) and len(ps) > 1 and is_run(ps[1]) and (not ss or not is_comma(ss[0])):
            hole = bare(ps[1])
            for b in self.bind(hole.text[4:] or "_", Span("", -1, -1), binds):
                yield from self.seq(ps[2:], ss, b)
        if ss:
            for b in self.element(p, ss[0], binds):
                yield from self.seq(ps[1:], ss[1:], b)


@dataclass
class Match:
    node: Node | Token
    binds: Binds


class Pattern:
    """A compiled pattern; `kind:`, `regex:` and `comment:` are its other forms."""

    def __init__(self, src: str):
        self.src, self.form, self.tree = src, "code", None
        self.names: set[str] = set()
        self.groups: list[int] = []
        for form in ("kind", "regex", "comment"):
            if src.startswith(form + ":"):
                self.form = form
                body = src[len(form) + 1:]
                self.kind = body.strip().lower()
                if form != "kind":
                    self.regex = re.compile(body, re.DOTALL)
                return
        for f in FRAGMENTS:
            self.tree = parse_fragment(src, f, pattern=True)
            if self.tree is not None:
                break
        if self.tree is None:
            raise PatternError(f"not a pattern: {src}")
        if bare(self.tree) is not None and bare(self.tree).kind == "PatternHole":
            raise PatternError("a pattern of a hole alone matches everything")
        toks = list(self.tree.tokens())
        if self.focus_count() > 1:
            raise PatternError("at most one ^ in a pattern")
        self.names = {t.text.lstrip("$.") for t in toks if t.kind in ("PatternCapture", "PatternSeqCapture")} - {"_"}
        self.groups = [t.start for t in toks if t.kind == "PatternGroupOpen"]

    def focus_count(self) -> int:
        return sum(n.kind == "PatternFocus" for n in self.tree.walk())

    def named(self, binds: Binds) -> Binds:
        """Groups by number instead of by place."""
        out = {k: v for k, v in binds.items() if not k.startswith("#")}
        for i, at in enumerate(self.groups):
            if f"#{at}" in binds:
                out[str(i + 1)] = binds[f"#{at}"]
        return out

    def find(self, tree: Tree, root: Node | None = None) -> Iterator[Match]:
        root = root or tree.root
        if self.form == "comment":
            lo, hi = (root.start, root.end) if root is not tree.root else (0, len(tree.text))
            for t in tree.tokens:
                if t.kind in COMMENTS and lo <= t.start < hi and self.regex.search(t.text):
                    yield Match(t, {})
            return
        m = Matcher(tree.text)
        for n in root.walk():
            if self.form == "kind":
                if n.kind.lower() == self.kind and n.children:
                    yield Match(n, {})
            elif self.form == "regex":
                if n.children and self.regex.fullmatch(tree.text[n.start: n.end]):
                    yield Match(n, {})
            elif n.kind != "ParenExpr" or self.tree.kind == "ParenExpr":
                seen = set()
                for b in m.element(self.tree, n, {}):
                    place = (b["^"].start if "^" in b else None, tuple(v.start for k, v in sorted(b.items()) if k.startswith("#")))
                    if place not in seen:
                        seen.add(place)
                        yield Match(n, self.named(b))
                    if place == (None, ()):
                        break


# -- conditions --------------------------------------------------------------
class Condition:
    """`$X ~ glob`, `$X ~ /re/flags`, `$X : type` or a contained pattern."""

    def __init__(self, src: str, bound: set[str]):
        m = re.match(r"\s*\$(\w+)\s*([~:])\s*(.*)$", src, re.DOTALL)
        self.op, self.pattern = "", None
        if not m:
            self.pattern = Pattern(src)
            return
        self.name, self.op, body = m[1], m[2], m[3].strip()
        if self.name not in bound:
            raise PatternError(f"${self.name} is not captured")
        self.regex = re.compile(flagged_regex(body)) if self.op == "~" and body.startswith("/") else None
        self.parts = None if self.regex else glob_parts(body)
        for kind, ref in self.parts or ():
            if kind == "ref" and ref not in bound:
                raise PatternError(f"${ref} is not captured")

    def holds(self, m: Match, tree: Tree, type_of) -> bool:
        if self.pattern is not None:
            root = m.node if isinstance(m.node, Node) else None
            return root is not None and next(self.pattern.find(tree, root), None) is not None
        if self.name not in m.binds:
            return False
        read = (lambda b: b.text) if self.op == "~" else type_of
        value = read(m.binds[self.name])
        if value is None:
            return False
        if self.regex is not None:
            return self.regex.search(value) is not None
        out = []
        for kind, part in self.parts:
            if kind == "ref":
                other = read(m.binds[part]) if part in m.binds else None
                if other is None:
                    return False
                part = re.escape(other)
            out.append(part)
        return re.fullmatch("".join(out), value, re.IGNORECASE | re.DOTALL) is not None


# -- templates ---------------------------------------------------------------
def apply_transform(kind: str | None, text: str) -> str:
    if kind == "quote":
        return re.sub(r"([\\'])", r"\\\1", " ".join(text.split()))
    if kind == "id":
        words = re.findall(r"[A-Za-z0-9_]+", text)
        out = "".join(w if i == 0 else w[:1].upper() + w[1:] for i, w in enumerate(words))
        return "x" if not out else "k" + out if out[0].isdigit() else out
    return text


class Template:
    """Text with $NAME, $1, $NAME:quote and $NAME:id."""

    _REF = re.compile(r"\$(?:\.\.\.)?(\w+)(?::(quote|id)\b)?")

    def __init__(self, src: str, bound: set[str]):
        if re.search(r"(?<!\$)\.\.\.", src):
            raise PatternError("a bare ... has nothing to refer to")
        for m in self._REF.finditer(src):
            if m[1] not in bound:
                raise PatternError(f"${m[1]} is not captured")
        self.src = src

    def render(self, binds: Binds) -> str:
        return self._REF.sub(lambda m: apply_transform(m[2], binds[m[1]].text if m[1] in binds else ""), self.src)


class Let:
    """NAME = $SRC ~ PATTERN => TEMPLATE, or NAME = $SRC * PATTERN => TEMPLATE | SEP."""

    def __init__(self, spec: str, bound: set[str]):
        m = re.match(r"\s*(\w+)\s*=\s*\$(\w+)\s*([~*])\s*(.*?)\s*=> ?(.*)$", spec, re.DOTALL)
        if not m:
            raise PatternError(f"not a let: {spec}")
        self.name, self.source, self.mode = m[1], m[2], m[3]
        if self.source not in bound:
            raise PatternError(f"${self.source} is not captured")
        template, self.sep = m[5], ""
        if self.mode == "*" and "|" in template:
            template, _, self.sep = template.rpartition("|")
            template, self.sep = template.rstrip(" "), self.sep.removeprefix(" ")
        self.rules = [self.rule(m[4], template)]

    @staticmethod
    def rule(pattern: str, template: str) -> tuple[Pattern, Template]:
        p = Pattern(pattern)
        return p, Template(template, set(p.names) | {str(i + 1) for i in range(len(p.groups))})

    def merge(self, other: Let) -> None:
        if (other.source, other.mode) != (self.source, self.mode):
            raise PatternError(f"${self.name} has another source or mode")
        self.rules += other.rules

    def eval(self, tree: Tree, binds: Binds) -> Binds:
        src = binds.get(self.source)
        if src is None or src.start < 0:
            return binds | {self.name: Span("", -1, -1)}
        found = []
        for p, t in self.rules:
            found += [(m, t) for m in p.find(tree) if src.start <= m.node.start and m.node.end <= src.end]
        found = outermost([(m.node.start, m.node.end, t.render(m.binds)) for m, t in found])
        if self.mode == "*":
            return binds | {self.name: Span(self.sep.join(x[2] for x in found), -1, -1)}
        return binds | {self.name: Span(splice(tree.text, found, src.start, src.end), -1, -1)}


def outermost(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order without those inside another; crossing ones raise."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(set(edits), key=lambda e: (e[0], -e[1])):
        if out and e[0] < out[-1][1]:
            if e[1] > out[-1][1]:
                raise PatternError(f"matches at {out[-1][0]} and {e[0]} cross")
            continue
        out.append(e)
    return out


def splice(text: str, edits: list[tuple[int, int, str]], lo: int, hi: int) -> str:
    parts, at = [], lo
    for s, e, new in edits:
        parts += [text[at:s], new]
        at = e
    return "".join([*parts, text[at:hi]])
