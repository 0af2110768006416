import corpus_pipeline
from facetql.llm import exact_dedup, mixing, packing, quality
from facetql.llm.queries import tokenizer_path

from .test_dedup import brute_components
from .util import SF


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, columns = docs, docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, want, SF).write.parquet(path)
        got = spark.read.parquet(path)
        rows = {r["doc_id"]: r["text"] for r in want.collect()}
        if k < 4:
            assert got.columns == columns
        if k == 0:
            model = quality.fit(want, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(got) == ids(quality.score(want, model).filter("score >= 0.3"))
        if k == 1:
            last = {}
            for i, t in sorted(rows.items()):
                last[t.translate(str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower()))] = i
            assert ids(got) == set(last.values())
        if k == 2:
            keys = sorted(rows)
            assert ids(got) == {keys[i] for i, _, c in brute_components([rows[x] for x in keys], 5, 80, 100) if i == c}
        if k == 3:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(want).collect()}
            words = {}
            for r in got.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
            assert {i: n for i, n in taken.items() if n} == words
        if k == 4:
            total = sum(r["n"] for r in packing.pack(want, tokenizer_path("word_bpe_49k.json"), 2).groupBy().sum("length").toDF("n").collect())
            assert got.groupBy().sum("length").collect()[0][0] == total and got.select("doc_id").distinct().count() == want.select("doc_id").distinct().count()
        want = got


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}
