"""Writers: tab- and comma-separated text, and server-sent events.  Rows stream partition by partition."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame


def number(value: float | None) -> str:
    """At most seven decimals, no trailing zeros, no exponent."""
    if value is None:
        return ""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "∞" if value > 0 else "-∞"
    text = f"{value:.7f}".rstrip("0").rstrip(".")
    return "0" if text in ("", "-0") else text


def _cells(row: Iterable) -> list[str]:
    return [number(x) if isinstance(x, float) else "" if x is None else str(x) for x in row]


def rows(df: DataFrame) -> Iterator[list[str]]:
    for row in df.toLocalIterator():
        yield _cells(row)


def tsv(df: DataFrame) -> Iterator[str]:
    """Keys and metrics between tabs, nothing escaped."""
    for cells in rows(df):
        yield "\t".join(cells) + "\n"


def csv_lines(df: DataFrame) -> Iterator[str]:
    """Every field quoted."""
    for cells in rows(df):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(cells)
        yield out.getvalue()


def event(name: str, data: str) -> str:
    return f"event: {name}\n" + "".join(f"data: {line}\n" for line in data.split("\n")) + "\n"


def events(df: DataFrame, header: dict | None = None, chunk: int = 5000, steps: int = 1) -> Iterator[str]:
    """Progress and results as server-sent events."""
    yield event("totalsteps", str(steps))
    try:
        held, count = [], 0
        for line in tsv(df):
            held.append(line.rstrip("\n"))
            count += 1
            if len(held) == chunk:
                yield event("resultstream", "\n".join(held))
                held = []
        if held:
            yield event("resultstream", "\n".join(held))
        yield event("chunkcomplete", str(steps))
        yield event("header", json.dumps((header or {}) | {"rows": count}))
        yield event("complete", "")
    except Exception as e:  # the stream is the only way to tell the client
        yield event("servererror", json.dumps({"exception": type(e).__name__, "message": str(e)}))
