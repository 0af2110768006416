"""Regular expressions of filters: the subset that means the same here as in automaton-style dialects."""

from __future__ import annotations

import re

from ..errors import QueryError

SPECIAL = "&~@#<>\""


def anchored(pattern: str) -> str:
    """A whole-term Java pattern; signs with a meaning of their own elsewhere are refused unless escaped."""
    inside = escaped = False
    for c in pattern:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in SPECIAL:
            raise QueryError(f"{c!r} must be escaped in a regular expression")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from e
    return f"^(?:{pattern})$"
