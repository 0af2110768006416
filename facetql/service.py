"""The engine: statements in, results out, with limits, timeout, cache and a list of what runs."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import logging
import threading
import time
import weakref
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import results
from .errors import LimitError, QueryError
from .lang import ast
from .lang.lexer import Token, tokenize
from .lang.parser import parse, parse_groups, parse_parts, parse_select, parse_where
from .lang.splitter import Parts, split
from .operators.execute import MOST_GROUPS, Compiler
from .plans.logical import translate
from .sources.catalog import STRING, Catalog, Dataset

log = logging.getLogger("facetql")
VERSION = 1
TOP_TERMS = 100


@dataclass
class Limits:
    """Seconds, rows, and queries at a time per user."""

    timeout: float = 360
    wait: float = 300
    rows: int = MOST_GROUPS
    per_user: int = 2


@dataclass
class Running:
    number: int
    query: str
    user: str
    started: float = field(default_factory=time.time)


@dataclass
class Result:
    """A lazy result and what is known about it."""

    df: DataFrame
    statement: object
    totals: dict | None = None
    cached: bool = False
    key: str | None = None


class Engine:
    def __init__(self, spark: SparkSession, limits: Limits | None = None, cache_dir: str | None = None, clock=None):
        self.spark, self.limits, self.cache_dir = spark, limits or Limits(), cache_dir
        self.catalog = Catalog()
        self.clock = clock or (lambda: datetime.now().replace(microsecond=0))
        self._running: dict[int, Running] = {}
        self._numbers = itertools.count(1)
        self._slots: dict[str, threading.BoundedSemaphore] = {}
        self._same: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(4, thread_name_prefix="facetql")

    def register(self, name: str, df: DataFrame, **options) -> Dataset:
        return self.catalog.add(Dataset.of(name, df, **options))

    # Syntax only.

    def parse(self, query: str):
        return parse(query, self.catalog.aliases, self.clock())

    @staticmethod
    def split(query: str) -> Parts:
        return split(query)

    @staticmethod
    def tokenize(text: str) -> list[Token]:
        return tokenize(text)

    # Statements.

    def compiler(self, query: str | ast.Select) -> Compiler:
        statement = self.parse(query) if isinstance(query, str) else query
        if not isinstance(statement, ast.Select):
            raise QueryError("a select statement is needed")
        dataset = self.catalog.find(statement.source.dataset)
        return Compiler(dataset, translate(statement, dataset))

    def query(self, query: str | ast.Select) -> DataFrame:
        """The lazy result of any statement."""
        statement = self.parse(query) if isinstance(query, str) else query
        if isinstance(statement, ast.Show):
            return self.show()
        if isinstance(statement, ast.Describe):
            return self.describe(statement.dataset, statement.field)
        return self.compiler(statement).result()

    def show(self) -> DataFrame:
        rows = [(d.name, d.description) for d in sorted(self.catalog.datasets.values(), key=lambda d: d.name)]
        return self.spark.createDataFrame(rows, "dataset string, description string")

    def describe(self, name: str, of: str | None = None) -> DataFrame:
        dataset = self.catalog.find(name)
        if of is not None:
            return self.top_terms(dataset, of)
        rows = [(f.name, f.kind, f.description) for f in dataset.fields.values()]
        rows += [(m.name, "metric", m.description) for m in dataset.metrics.values() if not m.hidden]
        return self.spark.createDataFrame(rows, "name string, kind string, description string")

    def described(self, query: str) -> dict:
        """Show and describe as nested values, for JSON: names, kinds, units, and a field's top terms."""
        statement = self.parse(query)
        if isinstance(statement, ast.Show):
            return {"datasets": [{"name": d.name, "description": d.description} for d in sorted(self.catalog.datasets.values(), key=lambda d: d.name)]}
        if not isinstance(statement, ast.Describe):
            raise QueryError("a show or describe statement is needed")
        dataset = self.catalog.find(statement.dataset)
        if statement.field is None:
            fields = [{"name": f.name, "type": f.kind, "description": f.description} for f in dataset.fields.values()]
            metrics = [{"name": m.name, "unit": m.unit, "description": m.description} for m in dataset.metrics.values() if not m.hidden]
            return {"name": dataset.name, "description": dataset.description, "fields": fields, "metrics": metrics}
        f = dataset.fields.get(statement.field)
        if f is None:
            return {"name": "notfound", "type": STRING, "description": "Field not found", "topTerms": []}
        terms = [r["term"] for r in self.top_terms(dataset, f.name).collect()]
        return {"name": f.name, "type": f.kind, "description": f.description, "topTerms": terms}

    def top_terms(self, dataset: Dataset, name: str, k: int = TOP_TERMS) -> DataFrame:
        f = dataset.fields.get(name)
        if f is None or f.kind != STRING:
            return self.spark.createDataFrame([], "term string, rows long")
        terms = dataset.terms(f)
        terms = F.explode(F.array_distinct(terms)) if dataset.has_many(f) else terms
        counts = dataset.df.select(terms.alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        return counts.orderBy(F.desc("rows"), "term").limit(k)

    def missing(self, name: str, start: datetime, end: datetime) -> list[str]:
        """Hours of the range, as yyyyMMdd.HH intervals, in which the dataset has no row."""
        dataset = self.catalog.find(name)
        window = dataset.between(start, end)
        if window is None:
            return []
        hour = F.floor(dataset.terms(dataset.find(dataset.time)) / 3600)
        first = int((start - datetime(1970, 1, 1)).total_seconds() // 3600)
        last = int(-((start.__class__(1970, 1, 1) - end).total_seconds() // 3600))
        # Hours that hold rows, and the range's ends; an hour's gap reaches to the next one.
        ends = self.spark.createDataFrame([(first - 1,), (last,)], "h long")
        have = dataset.df.filter(window).select(hour.cast("long").alias("h")).filter((F.col("h") >= first) & (F.col("h") < last)).unionByName(ends).distinct()
        have = have.withColumn("next", F.lead("h").over(Window.orderBy("h"))).filter("next > h + 1").orderBy("h")
        gaps = []
        for r in have.toLocalIterator():
            gaps.append("-".join(time.strftime("%Y%m%d.%H", time.gmtime(x * 3600)) for x in (r["h"] + 1, r["next"])))
        return gaps

    # Execution.

    def cache_key(self, statement: ast.Select) -> str:
        """Normalised query without its limit, and the files it reads."""
        plain = ast.Select(statement.metrics, statement.source, statement.where, statement.groups)
        files = [(f, *self._version(f)) for f in sorted(self.catalog.find(statement.source.dataset).df.inputFiles())]
        return hashlib.sha1(json.dumps([VERSION, repr(plain), files]).encode()).hexdigest()

    def execute(self, query: str, user: str = "", totals: bool = False, cache: bool = True) -> Result:
        """Run under the limits; with a cache folder the whole result is kept, whatever the limit."""
        statement = self.parse(query)
        if not isinstance(statement, ast.Select):
            return Result(self.query(statement), statement)
        with self._slot(user), self._track(query, user), self._alone(repr(statement)):
            compiler = self.compiler(statement)
            key = self.cache_key(statement) if cache and self.cache_dir else None
            found = Result(compiler.ordered(), statement, key=key)
            if key:
                found.cached, found.df = self._cached(key, statement, compiler)
            else:
                found.df = self._held(found.df)
            if totals:
                found.totals = self._within(lambda: compiler.totals().collect()[0].asDict())
            return found

    def _held(self, df: DataFrame) -> DataFrame:
        """The result, computed under the limits and kept by Spark (in memory, then on disk) until it is no longer used."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = self._within(df.count)
            if rows > self.limits.rows:
                raise LimitError(f"more than {self.limits.rows} rows")
        except Exception:
            df.unpersist()
            raise
        weakref.finalize(df, df._jdf.unpersist)
        return df

    def _version(self, file: str) -> tuple[int, int]:
        """Length and time of a file: one that is replaced under its name is another."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
        return status.getLen(), status.getModificationTime()

    def _cached(self, key: str, statement: ast.Select, compiler: Compiler) -> tuple[bool, DataFrame]:
        path = f"{self.cache_dir}/{key}.parquet"
        hit = self._exists(f"{path}/_SUCCESS")
        if not hit:
            limit, compiler.query.limit = compiler.query.limit, None
            whole = compiler.ordered().withColumn("__place", F.monotonically_increasing_id())
            self._within(lambda: whole.write.mode("overwrite").parquet(path))
            compiler.query.limit = limit
        df = self.spark.read.parquet(path)
        if df.count() > self.limits.rows:
            raise LimitError(f"more than {self.limits.rows} rows")
        df = df.orderBy("__place")
        return hit, (df.limit(statement.limit) if statement.limit else df).drop("__place")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def submit(self, query: str, user: str = "") -> tuple[str, Future]:
        """Run in the background; the key names the stored result."""
        if not self.cache_dir:
            raise QueryError("background queries need a cache folder")
        key = self.cache_key(self.parse(query))
        return key, self._pool.submit(self.execute, query, user)

    def stored(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.cache_dir}/{key}.parquet").orderBy("__place").drop("__place")

    def stream(self, query: str, form: str = "tsv", user: str = "") -> Iterator[str]:
        """The result as text: tsv, csv or events."""
        result = self.execute(query, user, totals=form == "events")
        if form == "events":
            return results.events(result.df, {"totals": result.totals, "cached": result.cached})
        return {"tsv": results.tsv, "csv": results.csv_lines}[form](result.df)

    def running(self) -> list[Running]:
        return sorted(self._running.values(), key=lambda r: r.started)

    @contextlib.contextmanager
    def _track(self, query: str, user: str):
        own = Running(next(self._numbers), query, user)
        self._running[own.number] = own
        try:
            yield own
        except Exception as e:
            log.warning("user=%s seconds=%.3f error=%s query=%s", user, time.time() - own.started, e, query)
            raise
        else:
            log.info("user=%s seconds=%.3f query=%s", user, time.time() - own.started, query)
        finally:
            del self._running[own.number]

    @contextlib.contextmanager
    def _slot(self, user: str):
        with self._lock:
            slot = self._slots.setdefault(user, threading.BoundedSemaphore(self.limits.per_user))
        if not slot.acquire(timeout=self.limits.wait):
            raise LimitError(f"{self.limits.per_user} queries of {user or 'this user'} are running")
        try:
            yield
        finally:
            slot.release()

    @contextlib.contextmanager
    def _alone(self, name: str):
        """An equal query waits for the first."""
        with self._lock:
            lock = self._same.setdefault(name, threading.Lock())
        if not lock.acquire(timeout=self.limits.wait):
            raise LimitError("an equal query is running")
        try:
            yield
        finally:
            lock.release()

    def _within(self, action):
        """Run ``action`` as one job group, cancelled at the timeout."""
        group = f"facetql-{next(self._numbers)}"
        context = self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        context.setJobGroup(group, "query", interruptOnCancel=True)
        timer = threading.Timer(self.limits.timeout, stop)
        timer.start()
        too_late = LimitError(f"the query took more than {self.limits.timeout} s")
        try:
            found = action()
        except Exception as e:
            if late.is_set():
                raise too_late from e
            raise
        else:
            if late.is_set():  # between two jobs there was nothing to cancel
                raise too_late
            return found
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)


__all__ = ["Engine", "Limits", "Result", "parse_groups", "parse_parts", "parse_select", "parse_where"]
