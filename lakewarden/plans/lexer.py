"""SQL as tokens: kind, text, depth of parentheses, and place in the statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>'(?:[^']|'')*(?:'|\Z)|\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))"
    r'|(?P<quoted>"(?:[^"]|"")*(?:"|\Z))'
    r"|(?P<number>\d+(?:\.\d+)?)"
    r"|(?P<word>[^\W\d][\w$]*)"
    r"|(?P<symbol>::|<>|<=|>=|!=|\|\||.)",
    re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, quoted, number, word or symbol
    text: str
    depth: int
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        return self.text[1:-1].replace('""', '"') if self.kind == "quoted" else self.text

    @property
    def is_name(self) -> bool:
        return self.kind in ("word", "quoted")


def lex(sql: str) -> list[Token]:
    """Comments and blanks are left out; an open literal or comment runs to the end."""
    out, depth = [], 0
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "space" or m["space"] is not None:
            continue
        kind = next(k for k in ("string", "quoted", "number", "word", "symbol") if m[k] is not None)
        if m.group() == ")":
            depth = max(0, depth - 1)
        out.append(Token(kind, m.group(), depth, m.start(), m.end()))
        if m.group() == "(":
            depth += 1
    return out


def statements(sql: str) -> list[list[Token]]:
    """Tokens of each statement, split at semicolons outside literals."""
    out: list[list[Token]] = [[]]
    for t in lex(sql):
        if t.text == ";" and t.kind == "symbol":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def dotted(tokens: list[Token], i: int) -> tuple[str | None, int]:
    """A name with up to two qualifiers at i, and the place after it."""
    if i >= len(tokens) or not tokens[i].is_name:
        return None, i
    parts = [tokens[i].name]
    i += 1
    while i + 1 < len(tokens) and tokens[i].text == "." and tokens[i + 1].is_name:
        parts.append(tokens[i + 1].name)
        i += 2
    return ".".join(parts), i
