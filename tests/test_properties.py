"""Random queries against a plain evaluator."""

import random
from datetime import datetime

import pytest

from facetql.service import Engine

ROWS = 60


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, -3, 0, 1, 5, 9]), sorted({rnd.choice("xyz") for _ in range(rnd.randint(0, 3))})) for i in range(ROWS)]
    own = Engine(spark, clock=lambda: datetime(2024, 1, 1))
    own.register("t", spark.createDataFrame(rows, "time long, s string, n long, m array<string>"))
    return own, rows


FILTERS = {
    "s=a": lambda r: r[1] == "a", "s!=a": lambda r: r[1] != "a", "s in (a,b)": lambda r: r[1] in ("a", "b"), "s not in (a,c)": lambda r: r[1] not in ("a", "c"),
    "n<1": lambda r: (r[2] or 0) < 1, "n>=1": lambda r: (r[2] or 0) >= 1, "n=5": lambda r: r[2] == 5, "n!=5": lambda r: r[2] != 5, "m=x": lambda r: "x" in r[3],
    "m!=y": lambda r: "y" not in r[3], 's=~"a|b"': lambda r: r[1] in ("a", "b"), "between(n,0,5)": lambda r: 0 <= (r[2] or 0) <= 5, "n%2=1": lambda r: abs(r[2] or 0) % 2 == 1 and (r[2] or 0) > 0,
}
KEYS = {
    "s": lambda r: [r[1]] if r[1] is not None else [], "n": lambda r: [r[2]] if r[2] is not None else [], "m": lambda r: r[3],
    "s in (b,a)": lambda r: [r[1]] if r[1] in ("a", "b") else [],
}


@pytest.mark.parametrize("seed", range(12))
def test_random_queries(table, seed):
    own, rows = table
    rnd = random.Random(seed)
    filters = rnd.sample(sorted(FILTERS), rnd.randint(0, 2))
    signs = [rnd.choice(["", "-"]) for _ in filters]
    keys = rnd.sample(["s", "n", "m"], rnd.randint(0, 2))
    if any(f.startswith(("s in", "s not")) for f in filters):
        keys = [k for k in keys if k != "s"]
    query = "from t 1970-01-01T00:00:00 1970-01-01T00:00:50 "
    if filters:
        query += "where " + " and ".join(s + f for s, f in zip(signs, filters)) + " "
    if keys:
        query += "group by " + ", ".join(keys) + " "
    query += "select count(), n, n*2-1, max(n,3)"
    want = {} if keys else {(): [0.0] * 4}
    for r in rows:
        if r[0] < 50 and all(FILTERS[f](r) != (s == "-") for s, f in zip(signs, filters)):
            groups = [()]
            for k in keys:
                groups = [g + (x,) for g in groups for x in KEYS[k](r)]
            n = r[2] or 0
            for g in groups:
                sums = want.setdefault(g, [0.0] * 4)
                for i, v in enumerate((1, n, n * 2 - 1, max(n, 3))):
                    sums[i] += v
    got = {tuple(r)[: len(keys)]: list(tuple(r)[len(keys) :]) for r in own.query(query).collect()}
    assert got == want, query
