"""Compilation of a logical query to one lazy DataFrame.

Rows are filtered once, get one key column per grouping, and are aggregated by all keys together: one partial and
one final hash aggregation.  Groups that must be there although no row falls into them are given as data
("parents"): the listed terms, the buckets, the terms seen anywhere, multiplied with the parents before them; they are
joined to the aggregate at the end.  Which groups those are depends on a grouping's kind and on whether it is the last:

=============  ==========================================  ===========================================
grouping       not last                                    last
=============  ==========================================  ===========================================
field          (parent, term) with rows                    the same
field*         every parent with every term seen           the same
field in (..)  every parent with every listed term         terms with rows
top k          k terms of each parent                      and a row with an empty key for parents without
buckets        every parent with every bucket              the same
=============  ==========================================  ===========================================

``distinct`` and ``percentile`` count as a last grouping of their own, so groupings beside them are "not last".  Empty
groups have sums of 0 and ratios of NaN; the empty-key row of top k has zeros throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import LimitError, QueryError
from ..functions.metrics import Distinct, Metrics, Percentile, Ratio, Sum, quotient
from ..functions.predicates import Predicates
from ..plans.logical import ByBuckets, ByField, ByGrid, ByTerms, ByTop, Logical
from ..sources.catalog import INT, STRING, TIME, Dataset

MOST_GROUPS = 1_000_000
#: Slices of a field's range, for running counts without groups.
SLICES = 4096


@dataclass
class Keys:
    """Key columns so far; ``parents`` holds the tuples that must appear, None if only those with rows."""

    columns: list[str]
    order: list[str]
    parents: DataFrame | None = None


class Compiler:
    def __init__(self, dataset: Dataset, query: Logical):
        self.dataset, self.query = dataset, query
        self.spark: SparkSession = dataset.df.sparkSession
        self.metrics, self.predicates = Metrics(dataset), Predicates(dataset)
        self.wanted = [self.metrics.aggregate(m) for m in query.metrics]
        self.beyond = any(isinstance(m, (Distinct, Percentile)) for m in self.wanted)
        self.ready: DataFrame | None = None

    # Rows.

    def _filtered(self, also: bool) -> DataFrame:
        df = self.dataset.df
        window = self.dataset.between(self.query.source.start, self.query.source.end)
        if window is not None:
            df = df.filter(window)
        for e in self.query.filters + (self.query.row_filters if also else []):
            df = df.filter(self.predicates.compile(e))
        return df

    def _aggregates(self) -> list[Column]:
        out = []
        for i, m in enumerate(self.wanted, 1):
            if isinstance(m, Sum):
                out.append(F.sum(m.column).cast("double").alias(f"m{i}"))
            elif isinstance(m, Ratio):
                out.append(F.sum(m.top).alias(f"__top{i}"))
                if m.bottom is not None:
                    out.append(F.sum(m.bottom).alias(f"__bottom{i}"))
        return out or [F.count(F.lit(1)).alias("__rows")]

    def _distinct_counts(self) -> list[Column]:
        """Counts of distinct terms of fields with one value, in the same aggregation as the sums."""
        out = []
        for i, m in enumerate(self.wanted, 1):
            if isinstance(m, Distinct) and not self.dataset.has_many(f := self.dataset.find(m.field)):
                term = self.dataset.terms(f).cast("long" if f.kind in (INT, TIME) else "string")
                out.append(F.countDistinct(term).cast("double").alias(f"m{i}"))
        return out

    def totals(self) -> DataFrame:
        """One row with the metrics over all filtered rows; without distinct and percentile."""
        df = self._filtered(False)
        found = df.agg(*self._aggregates())
        return found.select(*[self._value(i, m, found.columns).alias(f"m{i}") for i, m in enumerate(self.wanted, 1) if isinstance(m, (Sum, Ratio))])

    def _value(self, i: int, m, columns: list[str]) -> Column:
        if isinstance(m, Sum):
            return F.coalesce(F.col(f"m{i}"), F.lit(0.0))
        if isinstance(m, Ratio):
            top = F.coalesce(F.col(f"__top{i}"), F.lit(0))
            if m.constant is not None:
                return top.cast("double") / F.lit(float(m.constant))
            return quotient(top, F.coalesce(F.col(f"__bottom{i}"), F.lit(0)))
        return F.coalesce(F.col(f"m{i}"), F.lit(0.0))

    # The whole query.

    def result(self) -> DataFrame:
        """Columns g1.. (keys) and m1.. (doubles)."""
        docs, keys = self._filtered(True), Keys([], [])
        last = len(self.query.groups) - (0 if self.beyond else 1)
        for i, g in enumerate(self.query.groups):
            docs, keys = self._group(docs, keys, i + 1, g, i == last)
        found = self._aggregate(docs, keys)
        if self.query.limit is not None:
            found = found.orderBy(*self.ordering(keys)).limit(self.query.limit)
        outputs = [c for c in found.columns if c.startswith("g")]
        return found.select(*sorted(outputs, key=lambda c: int(c[1:])), *[f"m{i}" for i in range(1, len(self.wanted) + 1)])

    def ordered(self) -> DataFrame:
        """The result in canonical order, for writers."""
        limit, self.query.limit = self.query.limit, None
        docs, keys = self._filtered(True), Keys([], [])
        last = len(self.query.groups) - (0 if self.beyond else 1)
        for i, g in enumerate(self.query.groups):
            docs, keys = self._group(docs, keys, i + 1, g, i == last)
        found = self._aggregate(docs, keys).orderBy(*self.ordering(keys))
        self.query.limit = limit
        if limit is not None:
            found = found.limit(limit)
        outputs = [c for c in found.columns if c.startswith("g")]
        return found.select(*sorted(outputs, key=lambda c: int(c[1:])), *[f"m{i}" for i in range(1, len(self.wanted) + 1)])

    def ordering(self, keys: Keys) -> list[Column]:
        """A plain last field is in term order first; all else in order of the groups."""
        order = list(keys.order)
        plain = self.query.groups and not self.beyond and isinstance(self.query.groups[-1], (ByField, ByTerms))
        if plain and not getattr(self.query.groups[-1], "explode", False):
            order = order[-1:] + order[:-1]
        return [F.col(c).asc_nulls_last() for c in order] or [F.lit(0)]

    # Groupings.

    def _exploded(self, docs: DataFrame, name: str, out: str, outer: bool = False) -> DataFrame:
        """``docs`` with a term of the field in column ``out``; rows without a term are left out, or have a null (``outer``)."""
        f = self.dataset.find(name)
        terms = self.dataset.terms(f)
        if self.dataset.has_many(f):
            if f.kind == INT:
                terms = terms.cast("array<bigint>")
            terms = F.array_distinct(F.array_compact(terms))
            return docs.withColumn(out, (F.explode_outer if outer else F.explode)(terms))
        column = terms.cast("long") if f.kind in (INT, TIME) else terms.cast("string")
        docs = docs.withColumn(out, column)
        return docs if outer else docs.filter(F.col(out).isNotNull())

    def _present(self, docs: DataFrame, keys: Keys) -> DataFrame | None:
        """The parent tuples: those required, or those that have rows."""
        if keys.parents is not None:
            return keys.parents
        return docs.select(*keys.columns).distinct() if keys.columns else None

    @staticmethod
    def _times(parents: DataFrame | None, dimension: DataFrame, n: int) -> DataFrame:
        """Every parent with every one of a dimension's n rows; what that makes is checked first."""
        if parents is None:
            return dimension
        if parents.limit(MOST_GROUPS // n + 1).count() > MOST_GROUPS // n:
            raise LimitError(f"groups with {n} buckets or terms each exceed {MOST_GROUPS} groups", "group by")
        return parents.crossJoin(F.broadcast(dimension))

    def _group(self, docs: DataFrame, keys: Keys, i: int, g, last: bool) -> tuple[DataFrame, Keys]:
        key = f"g{i}"
        if isinstance(g, ByField):
            rows = self._exploded(docs, g.field, key)
            parents = None
            if g.explode:
                parents = self._times_terms(self._present(docs, keys), rows.select(key).distinct())
            return rows, Keys([*keys.columns, key], [*keys.order, key], parents)
        if isinstance(g, ByTerms):
            return self._terms(docs, keys, i, g, last)
        if isinstance(g, ByTop):
            return self._top(docs, keys, i, g, last)
        if isinstance(g, ByGrid):
            docs, keys = self._buckets(docs, keys, i, g.x, "x")
            docs, keys = self._buckets(docs, keys, i, g.y, "y")
            label = F.concat_ws(", ", f"__x{i}", f"__y{i}")
            parents = keys.parents.withColumn(key, label)
            docs = docs.withColumn(key, label)
            return docs, Keys([*[c for c in keys.columns if c not in (f"__x{i}", f"__y{i}")], key], keys.order, parents.drop(f"__x{i}", f"__y{i}"))
        return self._buckets(docs, keys, i, g)

    def _times_terms(self, parents: DataFrame | None, terms: DataFrame) -> DataFrame:
        """Explode: parents times terms; the result's own size is the answer's, checked against the limit on groups."""
        t = terms.limit(MOST_GROUPS + 1).count()
        if parents is None:
            if t > MOST_GROUPS:
                raise LimitError(f"more than {MOST_GROUPS} terms exceed {MOST_GROUPS} groups", "group by")
            return terms
        p = parents.count()
        if p * t > MOST_GROUPS:
            raise LimitError(f"{p} groups with {t} terms each exceed {MOST_GROUPS} groups", "group by")
        return parents.crossJoin(terms)

    def _terms(self, docs: DataFrame, keys: Keys, i: int, g: ByTerms, last: bool) -> tuple[DataFrame, Keys]:
        key, at = f"g{i}", f"__o{i}"
        kind = "string" if self.dataset.find(g.field).kind == STRING else "long"
        listed = self.spark.createDataFrame([(t, n) for n, t in enumerate(g.terms)], f"{key} {kind}, {at} int")
        rows = self._exploded(docs, g.field, key).filter(F.col(key).isin(list(g.terms)))
        if last:
            return rows, Keys([*keys.columns, key], [*keys.order, key])
        parents = self._times(self._present(docs, keys), listed, max(1, len(g.terms)))
        places = F.array_position(F.array(*[F.lit(t).cast(kind) for t in g.terms]), F.col(key)) - 1
        return rows.withColumn(at, places.cast("int")), Keys([*keys.columns, key, at], [*keys.order, at], parents)

    def _score(self, g: ByTop, last: bool) -> Column:
        by = self.metrics.aggregate(g.metric)
        if isinstance(by, Sum):
            return F.sum(by.column).cast("double")
        if not isinstance(by, Ratio):
            raise QueryError("terms can't be ordered by this", "group by")
        if not last:
            raise QueryError("a ratio can order the last grouping only", "group by")
        return F.sum(by.top).cast("double") / F.lit(float(by.constant)) if by.constant is not None else quotient(F.sum(by.top), F.sum(by.bottom))

    def _ranked(self, sums: DataFrame, keys: Keys, key: str, rank: str, g: ByTop) -> DataFrame:
        """The best k terms of each parent by ``__score``, and a parent's null term if it has no other."""
        worst = float("inf") if g.bottom else float("-inf")
        score = F.when(F.isnan("__score"), F.lit(worst)).otherwise(F.col("__score"))
        order = [F.col(key).isNull(), score.asc() if g.bottom else score.desc(), F.col(key)]
        if keys.columns:
            window = Window.partitionBy(*keys.columns).orderBy(*order)
            best = sums.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= g.k)
        else:  # one group: the best k need no sort of all terms
            best = sums.orderBy(*order).limit(g.k)
            best = best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        return best.filter(F.col(key).isNotNull() | (F.col(rank) == 1)).drop("__score")

    def _top(self, docs: DataFrame, keys: Keys, i: int, g: ByTop, last: bool) -> tuple[DataFrame, Keys]:
        key, rank = f"g{i}", f"__r{i}"
        out = Keys([*keys.columns, key, rank], [*keys.order, rank])
        if last:
            self.ready = self._last_top(docs, keys, key, rank, g)
            return docs, out
        rows = self._exploded(docs, g.field, key)
        sums = rows.groupBy(*keys.columns, key).agg(self._score(g, last).alias("__score"))
        best = self._ranked(sums, keys, key, rank, g)
        on = None
        for c in [*keys.columns, key]:
            same = F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
            on = same if on is None else on & same
        return rows.alias("d").join(best.alias("b"), on).select("d.*", f"b.{rank}"), out

    def _last_top(self, docs: DataFrame, keys: Keys, key: str, rank: str, g: ByTop) -> DataFrame:
        """Metrics and rank come from one aggregation; a parent without terms has a row with an empty key."""
        rows = self._exploded(docs, g.field, key, outer=True)
        sums = rows.groupBy(*keys.columns, key).agg(self._score(g, True).alias("__score"), *self._aggregates())
        best = self._ranked(sums, keys, key, rank, g)
        if keys.parents is not None:
            best = self._beside(keys.parents.select(*keys.columns), best, keys)
        elif not keys.columns:
            root = self.spark.range(1).select(F.lit(0).alias("__root"))
            best = root.join(best, F.lit(True), "left").drop("__root")  # at most k rows
        kind = best.schema[key].dataType
        none = F.lit("") if kind.typeName() == "string" else F.lit(None).cast(kind)
        found = F.col(key).isNotNull()
        values = [F.when(found, self._value(n, m, best.columns)).otherwise(F.lit(0.0)).alias(f"m{n}") for n, m in enumerate(self.wanted, 1)]
        return best.select(*keys.columns, F.when(found, F.col(key)).otherwise(none).alias(key), F.coalesce(rank, F.lit(1)).alias(rank), *values)

    def _buckets(self, docs: DataFrame, keys: Keys, i: int, g: ByBuckets, axis: str = "") -> tuple[DataFrame, Keys]:
        key, at = (f"__{axis}{i}" if axis else f"g{i}"), f"__o{axis}{i}"
        n = (g.high - g.low - 1) // g.size + 1
        value = self.metrics.per_row(g.metric)
        inside = F.call_function("div", value - g.low, F.lit(g.size).cast("long"))
        place = F.when(value < g.low, F.lit(n).cast("long")).when(value >= g.high, F.lit(n + 1).cast("long")).otherwise(inside)
        rows = docs.withColumn(at, place)
        if not g.gutters:
            rows = rows.filter(F.col(at) < n)

        def label(place: Column) -> Column:
            low = place * F.lit(g.size).cast("long") + F.lit(g.low).cast("long")
            text = lambda x: x.cast("string") if g.time_format is None else F.date_format(_at(x), g.time_format)
            inner = F.concat(F.lit("["), text(low), F.lit(", "), text(low + g.size), F.lit(")"))
            if not g.gutters:
                return inner
            edge = lambda sign, x: F.concat(F.lit(sign), text(F.lit(x).cast("long")))
            return F.when(place == n, edge("< ", g.low)).when(place == n + 1, edge(">= ", g.high)).otherwise(inner)

        dimension = self.spark.range(n + 2 * g.gutters).select(F.col("id").alias(at))
        parents = self._times(self._present(docs, keys), dimension, n + 2 * g.gutters).withColumn(key, label(F.col(at)))
        return rows.withColumn(key, label(F.col(at))), Keys([*keys.columns, key, at], [*keys.order, at], parents)

    # Aggregation.

    def _aggregate(self, docs: DataFrame, keys: Keys) -> DataFrame:
        if self.ready is not None:
            return self.ready
        grouped = docs.groupBy(*keys.columns)
        found = grouped.agg(*self._aggregates(), *self._distinct_counts())
        for i, m in enumerate(self.wanted, 1):
            if f"m{i}" in found.columns:
                continue
            if isinstance(m, Distinct):
                found = self._beside(found, self._exploded(docs, m.field, "__t").groupBy(*keys.columns).agg(F.countDistinct("__t").cast("double").alias(f"m{i}")), keys)
            elif isinstance(m, Percentile):
                found = self._beside(found, self._percentile(docs, keys, i, m), keys)
        if keys.parents is not None:
            found = self._beside(keys.parents, found, keys)
        values = [self._value(i, m, found.columns).alias(f"m{i}") for i, m in enumerate(self.wanted, 1)]
        return found.select(*keys.columns, *values)

    @staticmethod
    def _beside(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
        if not keys.columns:
            return left.crossJoin(right)  # one row each
        on = None
        for c in keys.columns:
            same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
            on = same if on is None else on & same
        return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *[f"r.{c}" for c in right.columns if c not in keys.columns])

    def _percentile(self, docs: DataFrame, keys: Keys, i: int, m: Percentile) -> DataFrame:
        """The first term whose running count reaches percent/100 of the group's rows, else the last term.

        Rows without the field count in the group's size.  A string field's terms are read as integers.
        """
        f = self.dataset.find(m.field)
        many = self.dataset.has_many(f)
        if many:
            terms = self._exploded(docs, m.field, "__t")
        else:  # rows without a term are counted under null: one scan gives the group's size too
            terms = docs.withColumn("__t", self.dataset.terms(f).cast("long" if f.kind in (INT, TIME) else "string"))
        if f.kind == STRING:
            terms = terms.withColumn("__t", F.col("__t").try_cast("long"))
        counts = terms.groupBy(*keys.columns, "__t").agg(F.count(F.lit(1)).alias("__c"))
        if many:
            counts = counts.filter(F.col("__t").isNotNull())
            sizes = docs.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("__n"))
        if keys.columns:
            if not many:
                counts = counts.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys.columns)))
            window = Window.partitionBy(*keys.columns).orderBy(F.col("__t").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
            running = counts.withColumn("__upto", F.sum("__c").over(window))
        else:
            running = self._running_counts(counts)
        if many:
            running = self._beside(running, sizes, keys)
        target = F.lit(m.percent) / F.lit(100.0) * F.col("__n")
        reached = (F.col("__upto") >= target) & (F.col("__upto") - F.col("__c") < target)  # a null term's is null either way
        found = F.coalesce(F.min(F.when(reached, F.col("__t"))), F.max("__t"))
        return running.groupBy(*keys.columns).agg(found.cast("double").alias(f"m{i}"))


    @staticmethod
    def _running_counts(counts: DataFrame) -> DataFrame:
        """``__upto`` over the values ``__t``, and the sum ``__n``, in two levels: slices of the values' range, then within each."""
        place = F.col("__t").cast("double")
        ends = counts.agg(F.min(place).alias("__low"), F.max(place).alias("__high"), F.sum("__c").alias("__n"))
        step = (F.col("__high") - F.col("__low")) / F.lit(float(SLICES)) + F.lit(1.0)
        sliced = counts.crossJoin(F.broadcast(ends)).withColumn("__slice", F.floor((place - F.col("__low")) / step)).drop("__low", "__high")
        sums = sliced.groupBy("__slice").agg(F.sum("__c").alias("__held"))
        before = Window.orderBy(F.col("__slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("__slice").alias("__at"), F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"))
        inside = Window.partitionBy("__slice").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
        within = sliced.withColumn("__inside", F.sum("__c").over(inside))
        found = within.join(F.broadcast(sums), F.col("__slice").eqNullSafe(F.col("__at")))
        return found.withColumn("__upto", F.col("__before") + F.col("__inside")).drop("__slice", "__at", "__before", "__inside")


def _at(x: Column) -> Column:
    """A wall-clock time, whatever the session's zone."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("decimal(18,6)"))
