"""Filters as null-safe conditions, written so that they reach the files.

A negated term filter keeps rows without a value: ``f IS NULL OR f <> v``.  A metric comparison reads a missing
integer as 0: ``f < n OR f IS NULL`` where 0 < n.
"""

from __future__ import annotations

import operator
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..lang import ast, lucene
from ..lang.patterns import anchored
from ..sources.catalog import FLOAT, INT, STRING, TIME, Dataset, Field
from .metrics import Metrics

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}
FLIP = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "=": "!=", "!=": "="}
SEED_LENGTH = 32


class Predicates:
    def __init__(self, dataset: Dataset):
        self.dataset, self.metrics = dataset, Metrics(dataset)

    def compile(self, e, negated: bool = False) -> Column:
        if isinstance(e, ast.Un) and e.op == "-":
            return self.compile(e.arg, not negated)
        if isinstance(e, ast.Fn):
            return self._call(e, negated)
        if not isinstance(e, ast.Bin):
            raise QueryError("Syntax error in a Where condition", "where")
        if e.op == "and":
            if negated:
                return ~(self.compile(e.left) & self.compile(e.right))
            return self.compile(e.left) & self.compile(e.right)
        if e.op in ("in", "not in"):
            return self.terms(self.dataset.find(e.left.name), [self._text(x) for x in e.right.items], negated != (e.op == "not in"))
        if e.op in ("=~", "!=~"):
            return self._regex(e, negated != (e.op == "!=~"))
        if e.op in OPS:
            return self._comparison(e, negated)
        raise QueryError(f"{e.op} is not usable as a filter", "where")

    @staticmethod
    def _text(e) -> str:
        return e.name if isinstance(e, ast.Name) else str(e.value)

    # Terms.

    def terms(self, f: Field, values: list[str], negated: bool) -> Column:
        """Rows that have any of the terms, or none of them."""
        if f.kind == FLOAT:
            raise QueryError(f"{f.name} holds decimals and has no terms", "where")
        if f.tokenized and len(values) == 1:
            words = values[0].lower().split()
            has = [F.array_contains(self.dataset.terms(f), w) for w in words] or [F.lit(False)]
            column = F.col(f"`{f.name}`")
            found = has[0]
            for h in has[1:]:
                found = (found | h) if negated else (found & h)
            return column.isNull() | ~found if negated else found
        wanted = list(dict.fromkeys(values))
        if f.kind in (INT, TIME):
            wanted = [Metrics.int_term(f.name, v) for v in wanted]
        column = self.dataset.terms(f)
        if self.dataset.has_many(f):
            kind = "long" if f.kind == INT else "string"
            if f.multi and f.kind == INT:
                column = column.cast("array<bigint>")
            one = F.array_contains(column, F.lit(wanted[0]).cast(kind)) if len(wanted) == 1 else F.arrays_overlap(column, F.array(*[F.lit(w).cast(kind) for w in wanted]))
            found = F.coalesce(one, F.lit(False))
            return ~found if negated else found
        found = column == wanted[0] if len(wanted) == 1 else column.isin(wanted)
        if not negated:
            return found
        return column.isNull() | (column != wanted[0] if len(wanted) == 1 else ~column.isin(wanted))

    def _regex(self, e: ast.Bin, negated: bool) -> Column:
        f = self.dataset.find(self._text(e.left))
        if f.kind != STRING:
            raise QueryError(f"{f.name} is not a string field; regular expressions need one", "where")
        pattern = anchored(self._text(e.right))
        column = self.dataset.terms(f)
        if self.dataset.has_many(f):
            found = F.coalesce(F.exists(column, lambda x: x.rlike(pattern)), F.lit(False))
            return ~found if negated else found
        return column.isNull() | ~column.rlike(pattern) if negated else column.rlike(pattern)

    # Metrics.

    def _comparison(self, e: ast.Bin, negated: bool) -> Column:
        op = FLIP[e.op] if negated else e.op
        if isinstance(e.left, ast.Name):
            f = self.dataset.find(e.left.name)
            if e.op in ("=", "!=") and not isinstance(e.right, (ast.Bin, ast.Fn, ast.Un)):
                if not (isinstance(e.right, ast.Name) and f.kind in (INT, TIME) and e.right.name in self.dataset.fields):
                    return self.terms(f, [self._text(e.right)], op == "!=")
            if isinstance(e.right, ast.Num) and f.kind == INT and not f.multi:
                column = F.col(f"`{f.name}`")
                found = OPS[op](column, F.lit(e.right.value))
                return found | column.isNull() if OPS[op](0, e.right.value) else found
            if e.op not in ("=", "!=") and f.kind == STRING:
                raise QueryError(f"{f.name} is a string field and can't be compared by size", "where")
        for side in (e.left, e.right):
            if isinstance(side, ast.Bin) and side.op == "/":
                raise QueryError("a ratio of sums can't be a filter", "where")
        return OPS[op](self.metrics.per_row(e.left), self.metrics.per_row(e.right))

    # Functions.

    def _call(self, e: ast.Fn, negated: bool) -> Column:
        if e.name in ("lucene", "query"):
            found = F.coalesce(self.text_query(self._text(*self.metrics._args(e, 1, 1))), F.lit(False))
            return ~found if negated else found
        if e.name == "between":
            stat, low, high = self.metrics._args(e, 3, 3)
            low, high = self.metrics._number(low), self.metrics._number(high)
            if isinstance(stat, ast.Name) and (f := self.dataset.find(stat.name)).kind == INT and not f.multi:
                column = F.col(f"`{f.name}`")
                found = (column >= low) & (column <= high)
                if negated:
                    found = (column < low) | (column > high)
                return found | column.isNull() if (low <= 0 <= high) != negated else found
            value = self.metrics.per_row(stat)
            found = (value >= low) & (value <= high)
            return ~found if negated else found
        if e.name == "sample":
            return self._sample(e, negated)
        raise QueryError(f"unknown filter {e.name}()", "where")

    def _sample(self, e: ast.Fn, negated: bool) -> Column:
        args = self.metrics._args(e, 2, 4)
        f = self.dataset.find(self._text(args[0]))
        num = self.metrics._number(args[1])
        den = self.metrics._number(args[2]) if len(args) > 2 else 100
        if num < 0 or den < max(1, num):
            raise QueryError("sample() takes a share from 0 to the whole", "where")
        seed = self._text(args[3])[:SEED_LENGTH] if len(args) > 3 else secrets.token_hex(SEED_LENGTH // 2)
        drawn = lambda term: F.conv(F.substring(F.md5(F.concat(F.lit(seed), term.cast("string"))), 1, 8), 16, 10).cast("long") * den < num * (1 << 32)
        terms = self.dataset.terms(f)
        found = F.exists(terms, drawn) if self.dataset.has_many(f) else drawn(terms)
        found = F.coalesce(found, F.lit(False))
        return ~found if negated else found

    def text_query(self, text: str) -> Column:
        return self._tree(lucene.parse(text))

    def _tree(self, node: tuple) -> Column:
        kind, *rest = node
        if kind in ("and", "or"):
            found = self._tree(rest[0])
            for x in rest[1:]:
                found = found & self._tree(x) if kind == "and" else found | self._tree(x)
            return found
        if kind == "not":
            return ~F.coalesce(self._tree(rest[0]), F.lit(False))
        f = self.dataset.find(rest[0])
        terms, many = self.dataset.terms(f), self.dataset.has_many(f)
        if kind == "term":
            return self.terms(f, [rest[1]], False)
        if kind == "prefix":
            test = lambda x: x.cast("string").startswith(rest[1])
        else:
            low, high, closed = rest[1:]
            if f.kind in (INT, TIME):
                low, high = (x if x == "*" else Metrics.int_term(f.name, x) for x in (low, high))

            def test(x: Column) -> Column:
                found = F.lit(True)
                if low != "*":
                    found = x >= low if closed else x > low
                if high != "*":
                    found = found & (x <= high if closed else x < high)
                return found & x.isNotNull()

        return F.exists(terms, test) if many else test(terms)
