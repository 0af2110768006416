"""The language as Python calls: ``From(engine, "events", start, end).where(...).group_by(...).select(...)``."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame

from .lang import ast
from .lang.dates import parse_date
from .lang.parser import parse_groups, parse_select, parse_where
from .operators.execute import Compiler
from .plans.logical import translate
from .service import Engine
from .sources.catalog import Dataset


@dataclass(frozen=True)
class From:
    engine: Engine
    dataset: str
    start: datetime | str
    end: datetime | str
    filters: tuple = ()
    conditions: tuple = ()
    groups: tuple = ()
    metrics: tuple = ()
    rows: int | None = None

    def where(self, *filters: str | Column) -> From:
        """Filters of the language, or any condition on the dataset's columns."""
        texts = tuple(parse_where(f) for f in filters if isinstance(f, str))
        return replace(self, filters=self.filters + texts, conditions=self.conditions + tuple(f for f in filters if not isinstance(f, str)))

    def group_by(self, *groups: str) -> From:
        return replace(self, groups=self.groups + tuple(g for text in groups for g in parse_groups(text)))

    def select(self, *metrics: str) -> From:
        return replace(self, metrics=self.metrics + tuple(m for text in metrics for m in parse_select(text)))

    def limit(self, n: int) -> From:
        return replace(self, rows=n)

    def _compiler(self) -> Compiler:
        now = self.engine.clock()
        start, end = (parse_date(x, now) if isinstance(x, str) else x for x in (self.start, self.end))
        where = None
        for f in self.filters:
            where = f if where is None else ast.Bin("and", where, f)
        statement = ast.Select(self.metrics or parse_select(""), ast.From(self.dataset, start, end), where, self.groups, self.rows)
        own = self.engine.catalog.find(self.dataset)
        if self.conditions:
            df = own.df
            for c in self.conditions:
                df = df.filter(c)
            own = Dataset(own.name, df, own.time, own.fields, own.metrics, own.aliases)
        return Compiler(own, translate(statement, own))

    def dataframe(self) -> DataFrame:
        return self._compiler().result()

    def totals(self) -> DataFrame:
        return self._compiler().totals()
