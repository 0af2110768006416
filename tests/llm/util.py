import duckdb

SF = "/root/testdata/sf0.001"


def duck(**tables):
    """A DuckDB connection with small tables given as (schema, rows)."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None, partitions=2):
    """A documents table; texts by id, or (id, text) pairs."""
    pairs = list(enumerate(texts)) if not texts or not isinstance(texts[0], tuple) else texts
    rows = [(i, t, "en", sources[k] if sources else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


class Components:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
