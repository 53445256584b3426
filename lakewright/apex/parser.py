"""Apex tokens to a lossless tree. Parsing never fails: what cannot be read
becomes an ErrorNode and an entry in the list of errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .lexer import TRIVIA, Token, tokens

# Words of the language.
RESERVED = set("abstract break catch class continue delete do else enum extends final finally for global if implements insert instanceof interface merge new null override private protected public return static super this throw try undelete update upsert virtual void webservice while testmethod transient".split())
MODIFIERS = set("abstract final global override private protected public static testmethod transient virtual webservice".split())
ASSIGN = {"=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
LEVELS = [{"??"}, {"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!=", "<>", "===", "!=="}]
DML = {"insert": "InsertStmt", "update": "UpdateStmt", "delete": "DeleteStmt", "undelete": "UndeleteStmt", "upsert": "UpsertStmt", "merge": "MergeStmt"}
HOLES = {"PatternHole", "PatternCapture", "PatternSeqCapture"}
SOQL_CLAUSES = {"select", "from", "using", "where", "with", "group", "having", "order", "limit", "offset", "all", "for", "update"}


@dataclass(slots=True)
class Node:
    kind: str
    children: list = field(default_factory=list)

    @property
    def start(self) -> int:
        return self.children[0].start if self.children else -1

    @property
    def end(self) -> int:
        return self.children[-1].end if self.children else -1

    def nodes(self):
        return iter([c for c in self.children if c.__class__ is Node])

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if c.__class__ is Node]

    def tokens(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if n.__class__ is Token:
                yield n
            else:
                stack += n.children[::-1]

    def child(self, *kinds: str):
        for c in self.children:
            if c.__class__ is Node and c.kind in kinds:
                return c
        return None

    def word(self) -> str:
        if len(self.children) == 1 and self.children[0].__class__ is Token:
            return self.children[0].text
        return "".join(t.text for t in self.tokens())


@dataclass
class Error:
    start: int
    message: str


class Fail(Exception):
    pass


#: Stands behind the last token, as often as the parser looks ahead.
END = Token("Eof", "", -1, -1)
_LEVEL = {op: k for k, ops in enumerate(LEVELS) for op in ops}


class Parser:
    def __init__(self, text: str, pattern: bool = False):
        self.text, self.pattern = text, pattern
        self.all = tokens(text, pattern)
        self.toks = [t for t in self.all if t.kind not in TRIVIA] + [END] * 5
        self.i = 0
        self.errors: list[Error] = []

    # -- cursor ------------------------------------------------------------
    def tok(self, k: int = 0) -> Token | None:
        t = self.toks[self.i + k]
        return None if t is END else t

    def low(self, k: int = 0) -> str:
        return self.toks[self.i + k].key

    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k].kind

    def at(self, *words: str) -> bool:
        return self.toks[self.i].key in words

    def hole(self, k: int = 0) -> bool:
        return self.toks[self.i + k].kind in HOLES

    def name_at(self, k: int = 0, any_word: bool = False) -> bool:
        t = self.toks[self.i + k]
        return t.kind == "Word" and (any_word or t.key not in RESERVED) or t.kind == "PatternCapture"

    def bump(self, n: Node) -> Token:
        t = self.toks[self.i]
        if t is END:
            raise self.fail("unexpected end")
        n.children.append(t)
        self.i += 1
        return t

    def eat(self, n: Node, *words: str) -> bool:
        t = self.toks[self.i]
        if t.key in words:
            n.children.append(t)
            self.i += 1
            return True
        return False

    def fail(self, message: str) -> Fail:
        t = self.tok()
        return Fail(message, t.start if t else len(self.text))

    def need(self, n: Node, word: str) -> None:
        t = self.toks[self.i]
        if t.key != word:
            raise self.fail(f"expected '{word}'")
        n.children.append(t)
        self.i += 1

    def attempt(self, f: Callable):
        """f's result, or None with the cursor back where it was."""
        at, n = self.i, len(self.errors)
        try:
            return f()
        except Fail:
            self.i = at
            del self.errors[n:]
            return None

    def name(self, n: Node, any_word: bool = False) -> None:
        if not self.name_at(any_word=any_word):
            raise self.fail("expected a name")
        d = Node("DeclName")
        self.bump(d)
        n.children.append(d)

    def split_gt(self) -> None:
        """`>>` in type arguments is two tokens."""
        t = self.tok()
        if t and t.kind == "Op" and t.text.startswith(">") and len(t.text) > 1:
            self.toks[self.i: self.i + 1] = [Token("Op", c, t.start + k, t.start + k + 1) for k, c in enumerate(t.text)]

    # -- types -------------------------------------------------------------
    def type_ref(self, suffix: bool = True) -> Node:
        n = Node("Type")
        if self.kind() == "PatternGroupOpen":
            n.children.append(self.group(lambda: self.type_ref(suffix)))
            return n
        if self.hole():
            self.bump(n)
        elif self.at("void"):
            self.bump(n)
        else:
            if not (self.name_at() or self.at("set", "list", "map")):
                raise self.fail("expected a type")
            self.bump(n)
            while True:
                if self.at("<"):
                    n.children.append(self.type_args())
                if self.at(".") and self.name_at(1, True) and self.low(1) != "class":
                    self.bump(n)
                    self.bump(n)
                else:
                    break
        while suffix and self.at("[") and self.low(1) == "]":
            self.bump(n)
            self.bump(n)
        return n

    def type_args(self) -> Node:
        n = Node("TypeArgList")
        self.need(n, "<")
        while True:
            n.children.append(self.type_ref())
            if not self.eat(n, ","):
                break
        self.split_gt()
        self.need(n, ">")
        return n

    # -- expressions -------------------------------------------------------
    def expr(self) -> Node:
        left = self.ternary()
        if self.low() in ASSIGN:
            n = Node("BinExpr", [left])
            self.bump(n)
            n.children.append(self.expr())
            return n
        return left

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.at("?"):
            n = Node("TernaryExpr", [cond])
            self.bump(n)
            n.children.append(self.expr())
            self.need(n, ":")
            n.children.append(self.ternary())
            return n
        return cond

    def binary(self, level: int) -> Node:
        left = self.relational()
        while (at := _LEVEL.get(self.toks[self.i].key, -1)) >= level:
            n = Node("BinExpr", [left])
            self.bump(n)
            n.children.append(self.binary(at + 1))
            left = n
        if self.pattern and level == 0 and self.kind() == "PatternCapture" and not (len(left.children) == 1 and isinstance(left.children[0], Token) and left.children[0].kind == "PatternHole") and self.starts_expr(1):
            n = Node("BinExpr", [left])
            self.bump(n)
            n.children.append(self.binary(1))
            return n
        return left

    def starts_expr(self, k: int) -> bool:
        t = self.tok(k)
        return t is not None and (t.kind in HOLES or t.kind.endswith("Literal") or t.kind in ("Word", "PatternGroupOpen") and t.low not in RESERVED - {"new", "this", "super", "null"} or t.text in ("(", "[", "!", "-", "+", "~", "++", "--"))

    def relational(self) -> Node:
        left = self.shift()
        while True:
            if self.at("instanceof"):
                n = Node("InstanceofExpr", [left])
                self.bump(n)
                n.children.append(self.type_ref())
            elif self.at("<", ">", "<=", ">="):
                n = Node("BinExpr", [left])
                self.bump(n)
                n.children.append(self.shift())
            else:
                return left
            left = n

    def shift(self) -> Node:
        left = self.additive()
        while self.at("<", ">") and self.tok(1) and self.low(1) == self.low() and self.tok(1).start == self.tok().end:
            n = Node("BinExpr", [left])
            while self.tok(1) and self.low(1) == self.low() and self.tok(1).start == self.tok().end:
                self.bump(n)
            self.bump(n)
            n.children.append(self.additive())
            left = n
        return left

    def additive(self) -> Node:
        left = self.multiplicative()
        while self.at("+", "-"):
            n = Node("BinExpr", [left])
            self.bump(n)
            n.children.append(self.multiplicative())
            left = n
        return left

    def multiplicative(self) -> Node:
        left = self.unary()
        while self.at("*", "/"):
            n = Node("BinExpr", [left])
            self.bump(n)
            n.children.append(self.unary())
            left = n
        return left

    def unary(self) -> Node:
        if self.pattern and self.at("^"):
            n = Node("PatternFocus")
            self.bump(n)
            n.children.append(self.unary())
            return n
        if self.at("!", "~", "+", "-", "++", "--"):
            n = Node("UnaryExpr")
            self.bump(n)
            n.children.append(self.unary())
            return n
        if self.at("("):
            got = self.attempt(self.cast)
            if got:
                return got
        return self.postfix(self.primary())

    def cast(self) -> Node:
        n = Node("CastExpr")
        self.need(n, "(")
        n.children.append(self.type_ref())
        self.need(n, ")")
        if not self.starts_expr(0) or self.at("+", "-", "++", "--", "["):
            if not (self.at("[") and self.low(1) in ("select", "find")):
                raise self.fail("not a cast")
        n.children.append(self.unary())
        return n

    def group(self, inner: Callable[[], Node]) -> Node:
        g = Node("PatternGroup")
        self.bump(g)
        g.children.append(inner())
        self.need(g, "}")
        return g

    def primary(self) -> Node:
        t = self.tok()
        if t is None:
            raise self.fail("expected an expression")
        if t.kind == "PatternGroupOpen":
            return self.group(self.expr)
        if t.kind in HOLES:
            n = Node("NameExpr")
            self.bump(n)
            return n
        if t.kind.endswith("Literal") or t.low in ("true", "false", "null"):
            n = Node("LiteralExpr")
            self.bump(n)
            return n
        if t.text == "(":
            n = Node("ParenExpr")
            self.bump(n)
            n.children.append(self.expr())
            self.need(n, ")")
            return n
        if t.text == "[":
            return self.query()
        if t.low == "new":
            return self.new()
        if t.low in ("this", "super"):
            n = Node("ThisExpr" if t.low == "this" else "SuperExpr")
            self.bump(n)
            return self.call(n) if self.at("(") else n
        if t.kind == "Word" and t.low not in RESERVED:
            if self.low(1) == "<":
                # a generic type as a value: List<X>.class
                def generic() -> Node:
                    ty = self.type_ref()
                    if not self.at("."):
                        raise self.fail("not a type")
                    return ty

                got = self.attempt(generic)
                if got:
                    return got
            n = Node("NameExpr")
            self.bump(n)
            return self.call(n) if self.at("(") else n
        raise self.fail("expected an expression")

    def call(self, target: Node) -> Node:
        return Node("CallExpr", [target, self.args()])

    def args(self) -> Node:
        n = Node("ArgList")
        self.need(n, "(")
        while not self.at(")"):
            n.children.append(self.expr())
            if not self.eat(n, ","):
                break
        self.need(n, ")")
        return n

    def postfix(self, e: Node) -> Node:
        while True:
            if self.at(".", "?.") and (self.name_at(1, True) or self.hole(1)):
                n = Node("FieldExpr", [e])
                self.bump(n)
                d = Node("DeclName")
                self.bump(d)
                n.children.append(d)
                if self.at("("):
                    n.kind = "MethodCallExpr"
                    n.children.append(self.args())
                e = n
            elif self.at("[") and self.low(1) != "]":
                n = Node("IndexExpr", [e])
                self.bump(n)
                n.children.append(self.expr())
                self.need(n, "]")
                e = n
            elif self.at("++", "--"):
                e = Node("PostfixExpr", [e])
                self.bump(e)
            else:
                return e

    def new(self) -> Node:
        n = Node("NewExpr")
        self.bump(n)
        n.children.append(self.type_ref(suffix=False))
        if self.at("("):
            n.children.append(self.args())
        elif self.at("["):
            self.bump(n)
            if not self.at("]"):
                n.children.append(self.expr())
            self.need(n, "]")
            if self.at("{"):
                n.children.append(self.braces("ArrayInitializer"))
        elif self.at("{"):
            n.children.append(self.braces())
        else:
            raise self.fail("expected arguments or an initialiser")
        return n

    def braces(self, kind: str | None = None) -> Node:
        n = Node(kind or "SetInitializer")
        self.need(n, "{")
        while not self.at("}"):
            e = self.expr()
            if self.at("=>"):
                n.kind = "MapInitializer"
                m = Node("MapEntry", [e])
                self.bump(m)
                m.children.append(self.expr())
                e = m
            n.children.append(e)
            if not self.eat(n, ","):
                break
        self.need(n, "}")
        return n

    # -- queries in brackets -----------------------------------------------
    def query(self) -> Node:
        find = self.low(1) == "find"
        n = Node("SoslExpr" if find else "SoqlExpr")
        self.need(n, "[")
        if find:
            while self.tok() and not self.at("]"):
                self.soql_piece(n)
        else:
            self.soql_body(n, "]")
        self.need(n, "]")
        return n

    def soql_body(self, n: Node, close: str) -> None:
        if not self.at("select"):
            raise self.fail("expected SELECT")
        kinds = {"select": "SoqlSelectList", "from": "SoqlFromList", "using": "SoqlUsingScope", "where": "SoqlWhereClause", "with": "SoqlWithClause", "group": "SoqlGroupBy", "having": "SoqlGroupBy", "order": "SoqlOrderBy", "limit": "SoqlLimit", "offset": "SoqlOffset", "all": "SoqlAllRows", "for": "SoqlForClause", "update": "SoqlUpdateList"}
        while self.tok() and not self.at(close):
            w = self.low()
            if self.kind() in ("PatternHole", "PatternSeqCapture"):
                self.bump(n)
                continue
            if self.kind() == "PatternGroupOpen":
                n.children.append(self.group(lambda: self.clause(Node(kinds.get(self.low(1) and self.low(), "SoqlWhereClause")))))
                continue
            if w not in kinds:
                raise self.fail("expected a clause")
            n.children.append(self.clause(Node(kinds[w])))

    def clause(self, c: Node) -> Node:
        word = self.bump(c).low
        if word in ("group", "order") or word == "all":
            if self.at("by", "rows"):
                self.bump(c)
        if word in ("where", "having", "with") and not (word == "with" and self.low() in ("security_enforced", "user_mode", "system_mode", "data")):
            c.children.append(self.logical())
            return c
        while self.tok() and not self.at("]", ")", "}"):
            if self.low() in SOQL_CLAUSES and not (c.children and isinstance(c.children[-1], Token) and c.children[-1].text in (",", ".")) and (len(c.children) > (2 if word in ("group", "order", "all") else 1)):
                break
            if self.kind() in ("PatternHole", "PatternSeqCapture") and len(c.children) > 1 and not (isinstance(c.children[-1], Token) and c.children[-1].text == ","):
                break
            self.soql_piece(c)
        return c

    def soql_piece(self, c: Node) -> None:
        if self.at(":"):
            b = Node("SoqlBoundExpr")
            self.bump(b)
            b.children.append(self.bound())
            c.children.append(b)
        elif self.at("typeof"):
            t = Node("SoqlTypeOf")
            while self.tok() and not self.at("end"):
                self.soql_piece(t) if not self.at("typeof") else self.bump(t)
            self.need(t, "end")
            c.children.append(t)
        elif self.at("("):
            if self.low(1) == "select":
                s = Node("SoqlSubQuery")
                self.bump(s)
                self.soql_body(s, ")")
                self.need(s, ")")
                c.children.append(s)
            else:
                v = Node("SoqlValueList")
                self.bump(v)
                while self.tok() and not self.at(")"):
                    self.soql_piece(v)
                self.need(v, ")")
                c.children.append(v)
        elif self.kind() == "Word" or self.kind() == "PatternCapture":
            if self.low(1) == "(":
                f = Node("SoqlFunction")
                self.bump(f)
                self.bump(f)
                while self.tok() and not self.at(")"):
                    self.soql_piece(f)
                self.need(f, ")")
                c.children.append(f)
            else:
                f = Node("SoqlFieldName")
                self.bump(f)
                while self.at(".") and (self.name_at(1, True) or self.hole(1)):
                    self.bump(f)
                    self.bump(f)
                c.children.append(f)
        else:
            self.bump(c)

    def bound(self) -> Node:
        return self.postfix(self.primary())

    def logical(self) -> Node:
        n = Node("SoqlLogicalExpr")
        self.eat(n, "not")
        while True:
            n.children.append(self.comparison())
            if not self.eat(n, "and", "or"):
                return n

    def comparison(self) -> Node:
        if self.kind() in ("PatternHole", "PatternSeqCapture"):
            n = Node("SoqlComparison")
            self.bump(n)
            return n
        if self.at("("):
            n = Node("SoqlComparison")
            self.bump(n)
            n.children.append(self.logical())
            self.need(n, ")")
            return n
        n = Node("SoqlComparison")
        self.soql_piece(n)
        if not (self.at("=", "!=", "<>", "<", "<=", ">", ">=", "like", "in", "not", "includes", "excludes") or self.hole()):
            raise self.fail("expected a comparison")
        if self.bump(n).low == "not":
            self.need(n, "in")
        v = Node("SoqlValue")
        if self.at("-", "+"):
            self.bump(v)
        self.soql_piece(v)
        if self.at(":") and self.kind(1) == "IntegerLiteral":
            self.bump(v)
            self.bump(v)
        n.children.append(v)
        return n

    # -- statements --------------------------------------------------------
    def block(self) -> Node:
        n = Node("Block")
        self.need(n, "{")
        while self.tok() and not self.at("}"):
            n.children.append(self.recovering(self.statement, {"}", ";"}))
        self.need(n, "}")
        return n

    def recovering(self, f: Callable[[], Node], stops: set[str]) -> Node:
        """f's node; on failure the tokens up to a stop, as an ErrorNode."""
        at = self.i
        try:
            return f()
        except Fail as e:
            self.errors.append(Error(e.args[1], e.args[0]))
            self.i = at
            n, depth = Node("ErrorNode"), 0
            while self.tok():
                if depth == 0 and self.low() == "}" and n.children:
                    break
                t = self.bump(n)
                depth += t.text == "{"
                depth -= t.text == "}" and depth > 0
                if depth == 0 and t.text in stops:
                    break
            return n

    def statement(self) -> Node:
        w = self.low()
        if self.kind() == "PatternGroupOpen":
            return self.group(self.statement)
        if self.pattern and self.kind() in ("PatternHole", "PatternSeqCapture") and self.low(1) not in (".", "?.", "(", "[", "=", ";") and not (self.low(1) in ASSIGN):
            n = Node("ExprStmt")
            self.bump(n)
            return n
        if w == "{":
            return self.block()
        if w == "if":
            n = Node("IfStmt")
            self.bump(n)
            self.paren(n)
            n.children.append(self.statement())
            if self.eat(n, "else"):
                n.children.append(self.statement())
            return n
        if w == "switch" and self.low(1) == "on":
            return self.switch()
        if w == "for":
            return self.for_()
        if w == "while":
            n = Node("WhileStmt")
            self.bump(n)
            self.paren(n)
            n.children.append(self.statement()) if not self.at(";") else self.bump(n)
            return n
        if w == "do":
            n = Node("DoWhileStmt")
            self.bump(n)
            n.children.append(self.statement())
            self.need(n, "while")
            self.paren(n)
            self.need(n, ";")
            return n
        if w == "try":
            n = Node("TryStmt")
            self.bump(n)
            n.children.append(self.block())
            while self.at("catch"):
                n.children.append(self.catch())
            if self.at("finally"):
                f = Node("FinallyClause")
                self.bump(f)
                f.children.append(self.block())
                n.children.append(f)
            if len(n.children) == 2:
                raise self.fail("expected catch or finally")
            return n
        if w in ("return", "throw"):
            n = Node("ReturnStmt" if w == "return" else "ThrowStmt")
            self.bump(n)
            if not self.at(";"):
                n.children.append(self.expr())
            self.need(n, ";")
            return n
        if w in ("break", "continue"):
            n = Node("BreakStmt" if w == "break" else "ContinueStmt")
            self.bump(n)
            self.need(n, ";")
            return n
        if w in DML:
            n = Node(DML[w])
            self.bump(n)
            if self.at("as") and self.low(1) in ("user", "system"):
                a = Node("AccessLevelClause")
                self.bump(a)
                self.bump(a)
                n.children.append(a)
            n.children.append(self.expr())
            while not self.at(";"):
                n.children.append(self.expr() if w == "merge" else self.type_path())
            self.need(n, ";")
            return n
        if w == "system" and self.low(1) == "." and self.low(2) == "runas" and self.low(3) == "(":
            def run_as() -> Node:
                n = Node("RunAsStmt")
                for _ in range(3):
                    self.bump(n)
                n.children.append(self.args())
                n.children.append(self.block())
                return n

            got = self.attempt(run_as)
            if got:
                return got
        got = self.attempt(self.local_decl)
        if got:
            return got
        n = Node("ExprStmt", [self.expr()])
        if self.pattern and (self.hole() or self.at("}")):
            return n.children[0]  # in a pattern an expression may stand for itself
        self.need(n, ";")
        return n

    def type_path(self) -> Node:
        n = Node("QualifiedName")
        self.bump(n)
        while self.eat(n, "."):
            self.bump(n)
        return n

    def paren(self, n: Node) -> None:
        self.need(n, "(")
        n.children.append(self.expr())
        self.need(n, ")")

    def local_decl(self) -> Node:
        n = Node("LocalVarDeclStmt")
        self.modifiers(n)
        if any(c.kind == "Modifier" and c.word().lower() not in ("final", "transient") for c in n.nodes()):
            raise self.fail("not a local declaration")
        n.children.append(self.type_ref())
        self.declarators(n)
        self.need(n, ";")
        return n

    def declarators(self, n: Node) -> None:
        while True:
            d = Node("VarDeclarator")
            self.name(d)
            if not self.at("=", ",", ";", ":") or self.at(":") and n.kind not in ("ForInit",):
                raise self.fail("not a declaration")
            if self.eat(d, "="):
                d.children.append(self.expr())
            n.children.append(d)
            if not self.eat(n, ","):
                return

    def switch(self) -> Node:
        n = Node("SwitchStmt")
        self.bump(n)
        self.bump(n)
        n.children.append(self.expr())
        self.need(n, "{")
        while self.at("when"):
            w = Node("WhenClause")
            self.bump(w)
            if self.at("else"):
                self.bump(w)
            else:
                v = Node("WhenValue")
                if self.name_at() and self.name_at(1) and self.low(2) == "{":
                    v.children.append(self.type_ref())
                    self.name(v)
                else:
                    while True:
                        lit = Node("WhenLiteral")
                        lit.children.append(self.unary())
                        v.children.append(lit)
                        if not self.eat(v, ","):
                            break
                w.children.append(v)
            w.children.append(self.block())
            n.children.append(w)
        if self.hole():
            self.bump(n)
        self.need(n, "}")
        return n

    def for_(self) -> Node:
        n = Node("ForStmt")
        self.bump(n)
        self.need(n, "(")
        if self.hole() and self.low(1) == ")":
            self.bump(n)
        else:
            def each() -> list:
                m = Node("x")
                self.modifiers(m)
                m.children.append(self.type_ref())
                self.name(m)
                self.need(m, ":")
                m.children.append(self.expr())
                return m.children

            got = self.attempt(each)
            if got:
                n.kind = "ForEachStmt"
                n.children += got
            else:
                init = Node("ForInit")
                if not self.at(";"):
                    def decl() -> Node:
                        d = Node("ForInit")
                        self.modifiers(d)
                        d.children.append(self.type_ref())
                        self.declarators(d)
                        return d

                    init = self.attempt(decl) or self.expr_list(init)
                if init.children:
                    n.children.append(init)
                self.need(n, ";")
                if not self.at(";"):
                    n.children.append(self.expr())
                self.need(n, ";")
                if not self.at(")"):
                    n.children.append(self.expr_list(Node("ForUpdate")))
        self.need(n, ")")
        n.children.append(self.statement()) if not self.at(";") else self.bump(n)
        return n

    def expr_list(self, n: Node) -> Node:
        while True:
            n.children.append(self.expr())
            if not self.eat(n, ","):
                return n

    def catch(self) -> Node:
        n = Node("CatchClause")
        self.need(n, "catch")
        self.need(n, "(")
        if self.kind() == "PatternHole" and self.low(1) == ")":
            self.bump(n)
        else:
            self.modifiers(n)
            n.children.append(self.type_ref())
            self.name(n)
        self.need(n, ")")
        n.children.append(self.block())
        return n

    # -- declarations ------------------------------------------------------
    def modifiers(self, n: Node) -> None:
        while True:
            if self.at("@"):
                a = Node("Annotation")
                self.bump(a)
                if not self.name_at(any_word=True):
                    raise self.fail("expected a name")
                self.bump(a)
                if self.at("("):
                    args = Node("AnnotationArgList")
                    self.bump(args)
                    while self.tok() and not self.at(")"):
                        arg = Node("AnnotationArg")
                        arg.children.append(self.expr())
                        args.children.append(arg)
                        self.eat(args, ",")
                    self.need(args, ")")
                    a.children.append(args)
                n.children.append(a)
            elif self.low() in MODIFIERS and not (self.low() in ("transient",) and self.low(1) in (".", "=")):
                m = Node("Modifier")
                self.bump(m)
                n.children.append(m)
            elif self.at("with", "without", "inherited") and self.low(1) == "sharing":
                m = Node("Modifier")
                self.bump(m)
                self.bump(m)
                n.children.append(m)
            else:
                return

    def type_decl(self) -> Node:
        n = Node("ClassDecl")
        self.modifiers(n)
        return self.type_rest(n)

    def type_rest(self, n: Node) -> Node:
        if self.at("class"):
            n.kind = "ClassDecl"
            self.bump(n)
            self.name(n)
            if self.eat(n, "extends"):
                n.children.append(self.type_list("extends"))
            if self.eat(n, "implements"):
                n.children.append(self.type_list("implements"))
            n.children.append(self.body("ClassBody"))
            return n
        if self.at("interface"):
            n.kind = "InterfaceDecl"
            self.bump(n)
            self.name(n)
            if self.eat(n, "extends"):
                n.children.append(self.type_list("extends"))
            n.children.append(self.body("InterfaceBody"))
            return n
        if self.at("enum"):
            n.kind = "EnumDecl"
            self.bump(n)
            self.name(n)
            self.need(n, "{")
            c = Node("EnumConstantList")
            while self.tok() and not self.at("}"):
                self.name(c) if not self.hole() else self.bump(c)
                if not self.eat(c, ","):
                    break
            if c.children:
                n.children.append(c)
            self.need(n, "}")
            return n
        raise self.fail("expected a class, interface or enum")

    def type_list(self, what: str) -> Node:
        n = Node("TypeRefList")
        while True:
            n.children.append(self.type_ref())
            if not self.eat(n, ","):
                return n

    def body(self, kind: str) -> Node:
        n = Node(kind)
        self.need(n, "{")
        while self.tok() and not self.at("}"):
            if self.at(";"):
                self.bump(n)
                continue
            if self.kind() in ("PatternHole", "PatternSeqCapture") and not self.name_at(1):
                self.bump(n)
                continue
            n.children.append(self.recovering(self.member, {";", "}"}))
        self.need(n, "}")
        return n

    def member(self) -> Node:
        if self.at("{"):
            return Node("StaticInitializer", [self.block()])
        if self.at("static") and self.low(1) == "{":
            n = Node("StaticInitializer")
            self.bump(n)
            n.children.append(self.block())
            return n
        n = Node("FieldDecl")
        self.modifiers(n)
        if self.at("class", "interface", "enum"):
            return self.type_rest(n)
        if self.name_at() and self.low(1) == "(":
            n.kind = "ConstructorDecl"
            self.name(n)
        else:
            n.children.append(self.type_ref())
            self.name(n, any_word=True)
        if self.at("("):
            if n.kind != "ConstructorDecl":
                n.kind = "MethodDecl"
            n.children.append(self.params())
            if self.at("{"):
                n.children.append(self.block())
            elif not (self.pattern and not self.tok()):
                self.need(n, ";")
            return n
        if self.at("{"):
            n.kind = "PropertyDecl"
            self.bump(n)
            while self.tok() and not self.at("}"):
                a = Node("PropertyAccessor")
                self.modifiers(a)
                if self.hole():
                    self.bump(a)
                else:
                    if not self.at("get", "set"):
                        raise self.fail("expected get or set")
                    self.bump(a)
                    if self.at("{"):
                        a.children.append(self.block())
                    else:
                        self.need(a, ";")
                n.children.append(a)
            self.need(n, "}")
            return n
        self.i -= 1
        n.children.pop()
        while True:
            d = Node("VarDeclarator")
            self.name(d, any_word=True)
            if self.eat(d, "="):
                d.children.append(self.expr())
            n.children.append(d)
            if not self.eat(n, ","):
                break
        self.need(n, ";")
        return n

    def params(self) -> Node:
        n = Node("FormalParamList")
        self.need(n, "(")
        while not self.at(")"):
            p = Node("FormalParam")
            if self.hole() and self.low(1) in (",", ")"):
                self.bump(p)
            else:
                self.modifiers(p)
                p.children.append(self.type_ref())
                self.name(p, any_word=True)
            n.children.append(p)
            if not self.eat(n, ","):
                break
        self.need(n, ")")
        return n

    def trigger(self) -> Node:
        n = Node("TriggerUnit")
        self.need(n, "trigger")
        self.name(n)
        self.need(n, "on")
        n.children.append(self.type_ref())
        self.need(n, "(")
        while not self.at(")"):
            c = Node("TriggerCase")
            if self.hole():
                self.bump(c)
            else:
                self.bump(c)
                self.bump(c)
            n.children.append(c)
            if not self.eat(n, ","):
                break
        self.need(n, ")")
        n.children.append(self.block())
        return n


@dataclass
class Tree:
    root: Node
    errors: list[Error]
    tokens: list[Token]
    text: str


def parse(text: str, trigger: bool = False) -> Tree:
    """A whole source file; always gives a tree that holds every token."""
    p = Parser(text)
    root = Node("CompilationUnit")
    try:
        while p.tok():
            root.children.append(p.recovering(p.trigger if trigger else p.type_decl, {"}"}))
    except RecursionError:
        p.errors.append(Error(0, "nested too deeply"))
        root.children = [Node("ErrorNode", [t for t in p.toks if t is not END])]
    return Tree(root, p.errors, p.all, text)


def parse_fragment(text: str, what: str, pattern: bool = False) -> Node | None:
    """One construct that takes up all of text, or None."""
    p = Parser(text, pattern)
    rules = {"Expression": p.expr, "Statement": p.statement, "Block": p.block, "CatchClause": p.catch, "ClassMember": p.member, "TriggerUnit": p.trigger, "TypeDecl": p.type_decl}

    def bind() -> Node:
        n = Node("SoqlBoundExpr")
        p.need(n, ":")
        n.children.append(p.bound())
        return n

    try:
        n = bind() if what == "SoqlBind" else rules[what]()
    except (Fail, RecursionError):
        return None
    return n if p.tok() is None and not p.errors else None
