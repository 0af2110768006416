"""Tokens of expressions.  White space and SQL comments separate tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

KEYWORDS = ("and", "in", "not")
TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<single>'(?:[^']|'')*')
      |(?P<double>"(?:[^"\\]|\\.)*")
      |(?P<int>\d+)
      |(?P<name>[A-Za-z_]\w*)
      |(?P<op>!=~|=~|!=|<=|>=|[-+*/%,()\\\[\]<>=:])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # string, int, name, keyword, op
    value: str
    start: int
    end: int


def tokenize(text: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r}", offset=at)
        kind, raw = m.lastgroup, m.group()
        if kind == "single":
            tokens.append(Token("string", raw[1:-1].replace("''", "'"), at, m.end()))
        elif kind == "double":
            tokens.append(Token("string", re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), raw[1:-1], flags=re.S), at, m.end()))
        elif kind == "name" and raw.lower() in KEYWORDS:
            tokens.append(Token("keyword", raw.lower(), at, m.end()))
        elif kind != "skip":
            tokens.append(Token(kind, raw, at, m.end()))
        at = m.end()
    return tokens
