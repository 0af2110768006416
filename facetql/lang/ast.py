"""Syntax tree."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Num:
    value: int


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Tup:
    items: tuple


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Bin:
    """op: / < <= = != > >= + - * \\ % =~ !=~ in, not in, and."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Un:
    """op: - (negation) or * (explode)."""

    op: str
    arg: object


@dataclass(frozen=True)
class Brackets:
    field: str
    content: str


@dataclass(frozen=True)
class From:
    dataset: str
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Select:
    metrics: tuple
    source: From
    where: object | None = None
    groups: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class Show:
    pass


@dataclass(frozen=True)
class Describe:
    dataset: str
    field: str | None = None
