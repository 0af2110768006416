"""Time buckets over a stream, as a watermarked window aggregation.

A stream knows no end of its range and no absent bucket, so only buckets with rows appear; labels, metrics and filters
are those of the batch language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.metrics import Metrics, Sum
from ..functions.predicates import Predicates
from ..lang.dates import period_seconds
from ..lang.parser import parse_groups, parse_select, parse_where
from ..plans.logical import FORMAT
from ..sources.catalog import Dataset


def bucketed(dataset: Dataset, size: str, metrics: str = "count()", where: str = "", group_by: str = "", late: str = "10 minutes") -> DataFrame:
    """Columns g1 (bucket), g2.. (plain fields), m1..; rows later than ``late`` are dropped."""
    if dataset.time is None:
        raise QueryError(f"{dataset.name} has no time")
    seconds = period_seconds(size)
    if not seconds:
        raise QueryError(f"can't read the bucket size {size!r}")
    df, compiler = dataset.df, Metrics(dataset)
    if where:
        df = df.filter(Predicates(dataset).compile(parse_where(where)))
    found = [compiler.aggregate(m) for m in parse_select(metrics)]
    if not all(isinstance(m, Sum) for m in found):
        raise QueryError("sums only over a stream", "select")
    fields = [dataset.find(g.name).name for g in parse_groups(group_by)] if group_by else []
    df = df.withWatermark(dataset.time, late)
    keys = [F.window(F.col(dataset.time), f"{seconds} seconds").alias("__w"), *[F.col(f"`{f}`").alias(f"g{i}") for i, f in enumerate(fields, 2)]]
    sums = [F.sum(m.column).cast("double").alias(f"m{i}") for i, m in enumerate(found, 1)]
    for f in fields:
        df = df.filter(F.col(f"`{f}`").isNotNull())
    label = F.concat(F.lit("["), F.date_format("__w.start", FORMAT), F.lit(", "), F.date_format("__w.end", FORMAT), F.lit(")"))
    out = df.groupBy(*keys).agg(*sums)
    return out.select(label.alias("g1"), *[f"g{i}" for i in range(2, len(fields) + 2)], *[f"m{i}" for i in range(1, len(found) + 1)])
