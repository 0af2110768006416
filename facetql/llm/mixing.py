"""Mixing sources to target weights by capped water-filling.

Targets: the mix's size is shared among the sources by weight; a source's target stops at
``max_epochs`` times its own size, and what it cannot take is shared again by weight among the rest
until no target is above its cap.

Sampling: every row is taken ``floor(target / source size)`` whole times; the remaining fraction is
drawn by a seeded order within the source: rows are taken whole until the fraction's words are
reached, the row at the edge gives the words still missing.  A source's taken words thus equal its
rounded target, no row exceeds ``max_epochs`` repetitions, and reruns agree.

The order is md5 of id and seed.  Its prefix sums are taken in two levels (4096 slices of the hash
range per source, then rows within a slice), so a source holding a third of all rows is spread over
4096 tasks' worth of slices.  Only the table of sources reaches the driver, at most ``MAX_SOURCES`` rows
(beyond that an error, never a cut).

Null text has size 0, null source is a source of its own (last), null ids sort as the text "null", an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WHITE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], total: float, max_epochs: float = 2) -> list[float]:
    """Target of each source; caps are ``max_epochs * size``."""
    caps = [max_epochs * s for s in sizes]
    free = [i for i, w in enumerate(weights) if w > 0]
    while free:
        spent = sum(c for i, c in enumerate(caps) if i not in set(free) and weights[i] > 0)
        level = (total - spent) / sum(weights[i] for i in free)
        over = {i for i in free if caps[i] < level * weights[i]}
        if not over:
            return [min(caps[i], level * weights[i]) if i in set(free) else caps[i] * (weights[i] > 0) for i in range(len(sizes))]
        free = [i for i in free if i not in over]
    return [c * (w > 0) for c, w in zip(caps, weights)]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; with ``row_col``, a number of the rows, that too."""
    spark = docs.sparkSession
    name = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f"|{seed}")))
    numbered = [row_col] if row_col else []
    rows = scratch.materialize(
        docs.select(F.col(id_col).alias("doc_id"), name.alias("skey"), word_count(F.col(text_col)).alias("size"), order.alias("ord"), *numbered),
        "mix-sizes",
    )
    sources = rows.groupBy("skey").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = sorted(((r["skey"], r["s"]) for r in sources), key=lambda r: (r[0][0] == "n", r[0]))
    weights = [cycle[i % len(cycle)] for i in range(len(listed))]
    targets = water_fill([s for _, s in listed], weights, share * sum(s for _, s in listed), max_epochs)
    plan = spark.createDataFrame(
        [(k, s, float(t)) for (k, s), t in zip(listed, targets)], "skey string, source_size long, target double"
    )
    slices = rows.groupBy("skey", F.substring("ord", 1, 3).alias("slice")).agg(F.sum("size").alias("held"))
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy("skey", "slice").orderBy("ord", "doc_id", "size", *numbered).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        rows.withColumn("slice", F.substring("ord", 1, 3))
        .withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(slices, ["skey", "slice"])
        .join(F.broadcast(plan), "skey")
        .withColumn("whole", whole)
        .withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("offset") - F.col("start"))))
        .select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *numbered)
    )


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row once for each time the mix takes it; the last of a row's times may be its first words only.

    Rows are numbered once, in a written table, and meet their plan by that number: ids may be null or repeated.
    Documents of no words are taken whole as often as their source is.
    """
    rows = scratch.materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    plan = mix(rows, id_col, text_col, source_col, row_col="__row", **options).withColumn(
        "__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    )
    plan = plan.select(F.col("__row").alias("__planned"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), "__epochs")
    whole = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size")).cast("int")).otherwise(F.col("__epochs"))
    rest = F.when(F.col("__size") > 0, F.col("__taken") - whole * F.col("__size")).otherwise(F.lit(0))
    parts = F.filter(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.array(rest.cast("long"))), lambda x: x != 0)
    # The first n words, with the white space between them as it stands.
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + WHITE + "*"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("__part").cast("int")), "")
    repeated = rows.join(plan, rows["__row"] == plan["__planned"]).withColumn("__part", F.explode(parts))
    text = F.when(F.col("__part") < 0, F.col(text_col)).otherwise(head)
    return repeated.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
