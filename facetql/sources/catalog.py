"""Datasets: a DataFrame, its time column, its fields by kind, metrics and aliases."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

INT, STRING, FLOAT, TIME = "int", "string", "float", "time"
RESERVED = {"time", "bucket", "buckets", "lucene", "in"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    multi: bool = False
    tokenized: bool = False
    description: str = ""


@dataclass
class Metric:
    name: str
    description: str = ""
    unit: str = ""
    expression: str | None = None
    hidden: bool = False


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, WHOLE):
        return INT
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return None


@dataclass
class Dataset:
    name: str
    df: DataFrame
    time: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    description: str = ""

    @classmethod
    def of(cls, name: str, df: DataFrame, time: str | None = None, disabled: tuple[str, ...] = (), tokenized: tuple[str, ...] = ()) -> Dataset:
        """Fields are found from the schema: integers, strings, floats (for floatscale), times; arrays have several values."""
        own = cls(name, df, time)
        for f in df.schema:
            if any(re.fullmatch(p, f.name) for p in disabled):
                continue
            multi = isinstance(f.dataType, T.ArrayType)
            kind = _kind(f.dataType.elementType if multi else f.dataType)
            if kind and not (multi and kind in (FLOAT, TIME)):
                own.fields[f.name] = Field(f.name, kind, multi, f.name in tokenized)
        if time is None:
            own.time = next((n for n in ("unixtime", "time") if n in own.fields), None)
        elif time not in own.fields:
            raise QueryError(f"the time column {time!r} isn't in {name!r}")
        own._standard_aliases()
        return own

    def _standard_aliases(self) -> None:
        kinds = {f.kind for f in self.fields.values()}
        if kinds - {STRING}:
            self._alias("counts", "count()")
        if self.time:
            t = "unixtime" if "unixtime" not in self.fields or self.time == "unixtime" else self.time
            # Offsets in seconds of the week's and the day's start.
            self._alias("dayofweek", f"((({t}-280800)%604800)\\86400)")
            self._alias("timeofday", f"(({t}-21600)%86400)")

    def _alias(self, name: str, expression: str, over_field: bool = False) -> None:
        if name.lower() not in RESERVED and (over_field or name not in self.fields):
            self.aliases[name] = expression

    def find(self, name: str) -> Field:
        if name in ("unixtime", "time") and name not in self.fields and self.time:
            return self.fields[self.time]
        if name not in self.fields:
            raise QueryError(f"Unknown field: {name}")
        return self.fields[name]

    def terms(self, f: Field) -> Column:
        """The values of a field, as an array if it may have several."""
        column = F.col(f"`{f.name}`")
        if f.tokenized and not f.multi:
            return F.filter(F.split(F.lower(column), r"\s+"), lambda x: x != "")
        if f.kind == TIME:
            return seconds(column, self.df.schema[f.name].dataType)
        return column

    def has_many(self, f: Field) -> bool:
        return f.multi or f.tokenized

    def between(self, start, end) -> Column | None:
        """Rows with start <= time < end, on the column as it is stored, so that the filter reaches the files."""
        if self.time is None:
            return None
        column, kind = F.col(f"`{self.time}`"), self.df.schema[self.time].dataType
        if isinstance(kind, WHOLE):
            low, high = F.lit(epoch(start)), F.lit(epoch(end))
        elif isinstance(kind, T.TimestampType):
            low, high = (F.expr(f"TIMESTAMP '{x.isoformat(sep=' ')} UTC'") for x in (start, end))
        else:
            low, high = (F.expr(f"TIMESTAMP_NTZ '{x.isoformat(sep=' ')}'") for x in (start, end))
        return (column >= low) & (column < high)

    def read_dimensions(self, path: str | Path) -> list[str]:
        """Metrics of a ``name,description,unit,type,arg1,arg2`` file; gives the warnings."""
        with open(path, newline="", encoding="utf-8") as f:
            return self.add_dimensions(list(csv.reader(f)))

    def add_dimensions(self, rows: list[list[str]]) -> list[str]:
        warnings, composite = [], {}
        signs = {"add": "+", "subtract": "-", "multiply": "*", "divide": "\\"}
        for row in rows:
            if not row or not row[0].strip() or row[0].lstrip().startswith("# "):
                continue
            name, description, unit, kind, *args = [x.strip() for x in [*row, "", "", "", "", ""][:6]]
            name = name.removeprefix("#/")
            hidden = name.startswith("!")
            name = name.lstrip("!")
            metric = Metric(name, description, "" if unit == "null" else unit, hidden=hidden)
            if kind in signs:
                composite[name] = (args[0], signs[kind], args[1])
            elif kind == "lossless":
                scaled = re.fullmatch(r"floatscale\s+(\w+)(?:\s*\*\s*(-?\d+))?(?:\s*\+\s*(-?\d+))?", args[0])
                if scaled:
                    metric.expression = f"floatscale({scaled[1]},{scaled[2] or 1},{scaled[3] or 0})"
                    self._alias(name, metric.expression, over_field=True)
                elif args[0] != name:
                    metric.expression = args[0]
                    self._alias(name, args[0])
            else:
                warnings.append(f"{name}: unknown type {kind!r}")
                continue
            self.metrics[name] = metric
        for name in composite:
            text = self._resolve(name, composite, ())
            if text is None:
                warnings.append(f"{name}: refers to itself")
                self.metrics.pop(name, None)
            else:
                self.metrics[name].expression = text
                if not self.metrics[name].hidden:
                    self._alias(name, text)
        return warnings

    def _resolve(self, name: str, composite: dict, seen: tuple) -> str | None:
        if name in seen:
            return None
        if name not in composite:
            return self.aliases.get(name, name)
        left, sign, right = composite[name]
        left, right = (self._resolve(x, composite, (*seen, name)) for x in (left, right))
        return None if left is None or right is None else f"({left}{sign}{right})"


def epoch(when) -> int:
    return int((when - when.__class__(1970, 1, 1)).total_seconds())


def seconds(column: Column, kind: T.DataType) -> Column:
    """Unix seconds of a time column; times without zone count as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column)
    day = F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return day + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


class Catalog:
    """Datasets by name."""

    def __init__(self):
        self.datasets: dict[str, Dataset] = {}

    def add(self, dataset: Dataset) -> Dataset:
        self.datasets[dataset.name] = dataset
        return dataset

    def find(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise QueryError(f"Unknown dataset: {name}", "from")
        return self.datasets[name]

    def aliases(self, name: str) -> dict[str, str]:
        return self.datasets[name].aliases if name in self.datasets else {}
