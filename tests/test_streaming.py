from datetime import datetime

from facetql.sources.catalog import Dataset
from facetql.streaming.windows import bucketed


def test_buckets_over_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), k, n) for m, k, n in [(1, "a", 1), (4, "b", 2), (6, "a", 3), (7, None, 9), (59, "a", 5)]]
    df = spark.createDataFrame(rows, "ts timestamp, k string, n long")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    found = bucketed(Dataset.of("s", stream, time="ts"), "5m", "count(), n", "n!=5", "k")
    query = found.writeStream.outputMode("complete").format("memory").queryName("facets").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("facets").collect())
    first, second = "[2024-01-01 00:00:00, 2024-01-01 00:05:00)", "[2024-01-01 00:05:00, 2024-01-01 00:10:00)"
    assert got == [(first, "a", 1.0, 1.0), (first, "b", 1.0, 2.0), (second, "a", 1.0, 3.0)]
