"""Metrics.  Each is a long per row, summed over a group; ``/`` divides two such sums.

Decisions where the language leaves room: a missing integer reads 0, ``\\`` and ``%`` by zero give 0, overflow
raises (Spark's ANSI mode), ``mulshr(s,a,b)`` is ``(a*b) >> s`` and ``shldiv(s,a,b)`` is ``(a << s) \\ b``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..lang import ast
from ..sources.catalog import FLOAT, INT, STRING, TIME, Dataset

COMPARE = {"<", "<=", ">", ">=", "=", "!="}


@dataclass
class Sum:
    column: Column


@dataclass
class Ratio:
    top: Column
    bottom: Column | None = None
    constant: int | None = None


@dataclass
class Distinct:
    field: str


@dataclass
class Percentile:
    field: str
    percent: int


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def quotient(top: Column, bottom: Column) -> Column:
    """Division of doubles as IEEE has it: 0/0 is NaN, x/0 is an infinity."""
    top, bottom = top.cast("double"), bottom.cast("double")
    return (
        F.when(bottom != 0, top / F.when(bottom != 0, bottom))
        .when(top == 0, F.lit(float("nan")))
        .when(top > 0, F.lit(float("inf")))
        .when(top < 0, F.lit(float("-inf")))
    )


class Metrics:
    def __init__(self, dataset: Dataset):
        self.dataset = dataset

    def aggregate(self, e) -> Sum | Ratio | Distinct | Percentile:
        if isinstance(e, ast.Bin) and e.op == "/":
            top = self.per_row(e.left)
            if isinstance(e.right, ast.Num):
                if e.right.value == 0:
                    raise QueryError("division by zero", "select")
                return Ratio(top, constant=e.right.value)
            return Ratio(top, self.per_row(e.right))
        if isinstance(e, ast.Fn) and e.name == "distinct":
            (name,) = self._args(e, 1, 1)
            return Distinct(self.dataset.find(self._word(name)).name)
        if isinstance(e, ast.Fn) and e.name == "percentile":
            name, percent = self._args(e, 2, 2)
            percent = self._number(percent)
            if not 0 <= percent <= 100:
                raise QueryError(f"percentile must be from 0 to 100, not {percent}", "select")
            return Percentile(self.dataset.find(self._word(name)).name, percent)
        return Sum(self.per_row(e))

    def per_row(self, e) -> Column:
        if isinstance(e, ast.Num):
            return F.lit(e.value).cast("long")
        if isinstance(e, ast.Name):
            return self.field(e.name)
        if isinstance(e, ast.Str):
            raise QueryError(f"a metric is needed, not the text {e.value!r}", "select")
        if isinstance(e, ast.Un):
            raise QueryError("only numbers can be negated", "select")
        if isinstance(e, ast.Bin):
            return self._infix(e)
        if isinstance(e, ast.Fn):
            return self._call(e)
        raise QueryError(f"not usable as a metric: {e}", "select")

    def field(self, name: str) -> Column:
        f = self.dataset.find(name)
        if f.multi or f.kind == STRING:
            raise QueryError(f"{name} is not an integer field", "select")
        if f.kind == FLOAT:
            raise QueryError(f"{name} holds decimals; use floatscale({name}, multiplier, addend)", "select")
        return F.coalesce(self.dataset.terms(f).cast("long"), F.lit(0).cast("long"))

    def _infix(self, e: ast.Bin) -> Column:
        if e.op == "/":
            raise QueryError("a ratio of sums can't be part of another expression", "select")
        if e.op in ("=", "!=") and isinstance(e.left, ast.Name) and isinstance(e.right, (ast.Num, ast.Str, ast.Name)):
            has = self._equals_term(e.left, e.right)
            if has is not None:
                return has if e.op == "=" else F.lit(1).cast("long") - has
        if e.op not in COMPARE | {"+", "-", "*", "\\", "%"}:
            raise QueryError(f"{e.op} is not an operator of metrics", "select")
        a, b = self.per_row(e.left), self.per_row(e.right)
        if e.op == "\\":
            return F.coalesce(F.call_function("div", a, F.nullif(b, F.lit(0))), F.lit(0).cast("long"))
        if e.op == "%":
            return F.coalesce(a % F.nullif(b, F.lit(0)), F.lit(0).cast("long"))
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: flag(a < b), "<=": lambda: flag(a <= b),
            ">": lambda: flag(a > b), ">=": lambda: flag(a >= b), "=": lambda: flag(a == b), "!=": lambda: flag(a != b),
        }[e.op]()

    def _equals_term(self, left: ast.Name, right) -> Column | None:
        f = self.dataset.find(left.name)
        if isinstance(right, ast.Name):
            if right.name in self.dataset.fields and f.kind in (INT, TIME):
                return None
            return self.has_term(f.name, right.name)
        return self.has_term(f.name, str(right.value))

    def has_term(self, name: str, value: str) -> Column:
        """1 where the row has the term; 0 too where there is no such field."""
        if name not in self.dataset.fields and name not in ("time", "unixtime"):
            return F.lit(0).cast("long")
        f = self.dataset.find(name)
        if f.kind == FLOAT:
            raise QueryError(f"{name} holds decimals and has no terms", "select")
        term = F.lit(self.int_term(name, value)) if f.kind in (INT, TIME) else F.lit(value)
        terms = self.dataset.terms(f)
        if self.dataset.has_many(f):
            return flag(F.array_contains(terms, term.cast("long") if f.kind == INT else term))
        return flag(terms == term)

    @staticmethod
    def int_term(name: str, value) -> int:
        try:
            return int(value)
        except ValueError as err:
            raise QueryError(f"{name} is an integer field; {value!r} is no integer") from err

    def _args(self, e: ast.Fn, least: int, most: int | None) -> tuple:
        if len(e.args) < least or most is not None and len(e.args) > most:
            raise QueryError(f"{e.name}() takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments")
        return e.args

    @staticmethod
    def _word(e) -> str:
        if isinstance(e, ast.Name):
            return e.name
        if isinstance(e, (ast.Str, ast.Num)):
            return str(e.value)
        raise QueryError("a name is needed")

    @staticmethod
    def _number(e) -> int:
        if isinstance(e, ast.Num):
            return e.value
        raise QueryError("a number is needed")

    def _call(self, e: ast.Fn) -> Column:
        if e.name == "count":
            self._args(e, 0, 0)
            return F.lit(1).cast("long")
        if e.name == "cached":
            return self.per_row(*self._args(e, 1, 1))
        if e.name == "abs":
            return F.abs(self.per_row(*self._args(e, 1, 1)))
        if e.name in ("min", "max"):
            return (F.least if e.name == "min" else F.greatest)(*[self.per_row(a) for a in self._args(e, 2, None)])
        if e.name == "exp":
            args = self._args(e, 1, 2)
            scale = self._number(args[1]) if len(args) > 1 else 1
            if scale == 0:
                raise QueryError("the scale of exp() must not be 0", "select")
            return (F.exp(self.per_row(args[0]) / F.lit(float(scale))) * scale).cast("long")
        if e.name in ("mulshr", "shldiv"):
            shift, a, b = self._args(e, 3, 3)
            shift, a, b = self._number(shift), self.per_row(a), self.per_row(b)
            if not 0 <= shift < 64:
                raise QueryError(f"the shift of {e.name}() must be from 0 to 63", "select")
            if e.name == "mulshr":
                return F.shiftright(a * b, shift)
            return F.coalesce(F.call_function("div", F.shiftleft(a, shift), F.nullif(b, F.lit(0))), F.lit(0).cast("long"))
        if e.name == "dynamic":
            return self.field(self._word(*self._args(e, 1, 1)))
        if e.name in ("hasstr", "hasint"):
            args = self._args(e, 1, 2)
            if len(args) == 1:
                name, colon, value = self._word(args[0]).partition(":")
                if not colon:
                    raise QueryError(f"{e.name}() takes a field and a term", "select")
            else:
                name, value = (self._word(a) for a in args)
            if e.name == "hasint":
                self.int_term(name, value)
            return self.has_term(name, value)
        if e.name == "floatscale":
            args = self._args(e, 1, 3)
            f = self.dataset.find(self._word(args[0]))
            times, plus = [self._number(a) for a in args[1:]] + [1, 0][len(args) - 1 :]
            number = self.dataset.terms(f).cast("double") if f.kind != STRING else F.col(f"`{f.name}`").try_cast("double")
            return (F.coalesce(number, F.lit(0.0)) * F.lit(float(times)) + F.lit(float(plus))).cast("long")
        if e.name == "lucene":
            from .predicates import Predicates

            return flag(Predicates(self.dataset).text_query(self._word(*self._args(e, 1, 1))))
        raise QueryError(f"unknown function {e.name}()", "select")
