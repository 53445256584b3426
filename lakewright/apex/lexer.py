"""Apex source text to tokens; every character belongs to exactly one token."""

from __future__ import annotations

import re

TRIVIA = {"Whitespace", "LineComment", "BlockComment", "DocComment"}
COMMENTS = TRIVIA - {"Whitespace"}

_RULES = re.compile(
    r"""(?P<Whitespace>\s+)
    |(?P<LineComment>//[^\n]*)
    |(?P<DocComment>/\*\*(?!/).*?(?:\*/|\Z))
    |(?P<BlockComment>/\*.*?(?:\*/|\Z))
    |(?P<MultilineStringLiteral>'''.*?''')
    |(?P<StringLiteral>'(?:\\.|[^'\\\n])*'?)
    |(?P<DateTimeLiteral>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2}))
    |(?P<DateLiteral>\d{4}-\d{2}-\d{2}(?!\d))
    |(?P<LongLiteral>\d+[lL]\b)
    |(?P<NumberLiteral>\d*\.\d+[dD]?|\d+[dD]\b)
    |(?P<IntegerLiteral>\d+)
    |(?P<Word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<Op>>>>=|===|!==|<<=|>>=|\?\.|\?\?|\+\+|--|&&|\|\||==|!=|<>|=>|\+=|-=|\*=|/=|&=|\|=|\^=|<=|>=|[-+*/&|^~!<>=?:;,.(){}\[\]@])
    |(?P<Unknown>.)""",
    re.VERBOSE | re.DOTALL,
)
_WIDE = re.compile(r"[^\x00-\x7f]")
_HOLES = re.compile(r"(?P<PatternHole>\.\.\.)|(?P<PatternSeqCapture>\$\.\.\.[A-Za-z_]\w*)|(?P<PatternGroupOpen>\$\{)|(?P<PatternCapture>\$[A-Za-z_]\w*)")


class Token:
    """low: the text in lower case; key: the same for words and operators, else empty."""

    __slots__ = ("kind", "text", "start", "end", "low", "key")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end
        self.low = low = text.lower()
        self.key = low if kind == "Word" or kind == "Op" else ""

    def _all(self) -> tuple:
        return self.kind, self.text, self.start, self.end

    def __eq__(self, other) -> bool:
        return self._all() == other._all() if isinstance(other, Token) else NotImplemented

    def __hash__(self) -> int:
        return hash(self._all())

    def __repr__(self) -> str:
        return "Token(kind={!r}, text={!r}, start={!r}, end={!r})".format(*self._all())


def tokens(text: str, pattern: bool = False, at: int = 0) -> list[Token]:
    """Tokens with character offsets. pattern also reads holes and captures."""
    if not pattern:
        return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in _RULES.finditer(text, at)]
    out = []
    while at < len(text):
        m = _HOLES.match(text, at) or _RULES.match(text, at)
        kind = m.lastgroup
        if kind == "NumberLiteral" and m.group().startswith(".") and text.startswith("...", at):
            kind = "PatternHole"
        out.append(Token(kind, m.group(), at, m.end()))
        at = m.end()
    return out


def byte_offsets(text: str) -> list[int] | None:
    """Byte offset of each character and of the end; None if they are the same."""
    if text.isascii():
        return None
    out, done = [0], 0
    for m in _WIDE.finditer(text):
        # from the character before on, each one of ASCII is a byte further
        out.extend(range(out[-1] + 1, out[-1] + 1 + m.start() - done))
        out.append(out[-1] + len(m.group().encode("utf-8", "surrogatepass")))
        done = m.end()
    out.extend(range(out[-1] + 1, out[-1] + 1 + len(text) - done))
    return out
