"""Exact dedup, n-gram join and line dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from facetql.llm import exact_dedup, line_dedup, ngram_join, queries, scratch, words
from facetql.llm.components import connected_components

from .util import Components, docs_of, duck

UP = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())
EDGE_TEXTS = ["Abc", "aBC", "abc", None, "", " ", "É", "é", "x" * 200_000, "X" * 200_000, "abc"]


def want_groups(pairs):
    found = {}
    for i, t in pairs:
        found.setdefault((t or "").translate(UP), []).append(i)
    return sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in found.items() for i in ids)


def test_exact_groups(spark):
    docs = docs_of(spark, EDGE_TEXTS)
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(docs).drop("bucket").collect())
    assert got == want_groups(list(enumerate(EDGE_TEXTS)))


def test_exact_same_as_sql(spark):
    pairs = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    con = duck(documents=("doc_id BIGINT, text VARCHAR", pairs))
    assert sorted(con.execute(queries.OP7_SQL).fetchall()) == want_groups(pairs)


def test_buckets_split_and_results_stay(spark):
    texts = [f"text {i % 60}" for i in range(200)]
    index = exact_dedup.HashIndex(docs_of(spark, texts), bucket_bytes=64)
    assert index.directory.select("bucket").distinct().count() > 8
    got = sorted(tuple(r) for r in index.groups().select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want_groups(list(enumerate(texts)))


def test_directory_growth():
    cells = [(p, 10) for p in range(16)]
    leaves = exact_dedup.grow_directory(cells, 4, 25)
    assert {p for p, _, _ in leaves} == set(range(16)) and {d for _, _, d in leaves} == {3}
    assert exact_dedup.grow_directory([(5, 1000)], 4, 25) == [(5, 0, 0)] and exact_dedup.grow_directory([], 4, 25) == []


def test_chained_keys_compare_bodies(spark, monkeypatch):
    texts = ["a", "b", "a", "c", "b"]
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if c == ("body",) else real(*c))
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(docs_of(spark, texts)).drop("bucket").collect())
    assert got == want_groups(list(enumerate(texts)))


def test_repeated_rows_leave_one(spark):
    docs = docs_of(spark, [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (None, "c")])
    rows = exact_dedup.exact_groups(docs).collect()
    assert sum(r["kept"] for r in rows) == 3 and {r["keep_id"] for r in rows} == {1, 2, None}
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "c"), (1, "a"), (2, "b")]


def test_extra_and_clashing_columns(spark):
    docs = docs_of(spark, ["a", "A", "b"]).withColumns({"key": F.lit(1), "uid": F.lit("x"), "row": F.lit(2), "body": F.lit(0), "a.b": F.lit(3)})
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 2


def test_empty(spark):
    docs = docs_of(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0
    assert ngram_join.NgramJoin(docs).components().count() == 0
    assert line_dedup.LineDedup(docs).counts().count() == 0


# N-grams.


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").translate(UP).encode().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(texts, n, num, den):
    sets, found = brute_sets(texts, n), Components(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                found.join(i, j)
    return [(i, len(s), found.find(i)) for i, s in enumerate(sets)]


def family(rnd, count, length, edits):
    """Texts that differ from one another in a few words."""
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 6) + str(rnd.randint(0, 400)) for _ in range(length)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(length)] = f"new{rnd.randint(0, 99)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n,num,block", [(3, 90, 3_000_000), (5, 80, 3_000_000), (5, 80, 1500), (2, 60, 400)])
def test_components_same_as_brute_force(spark, n, num, block):
    rnd = random.Random(num + block)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c", "a b c d"] + family(rnd, 40, 60, 8) + family(rnd, 30, 200, 20)
    for size in range(3, 16):
        texts += family(rnd, 5, size, 1)
    texts += ["the same words " * 40, "the same words " * 41]
    rnd.shuffle(texts)
    rows = ngram_join.NgramJoin(docs_of(spark, texts, partitions=3), n, num, 100, block_ngrams=block).components().collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components(texts, n, num, 100)


@pytest.mark.parametrize("n,num,block", [(3, 90, 3_000_000), (5, 80, 1500), (2, 60, 400)])
def test_links_are_counted_whole(spark, n, num, block):
    rnd = random.Random(num)
    texts = ["one", "a b c", "a b c d", ""] + family(rnd, 30, 300, 2) + family(rnd, 40, 60, 8) + family(rnd, 30, 200, 20) + family(rnd, 20, 12, 1)
    sets = brute_sets(texts, n)
    kinds = {frozenset(s) for s in sets}
    want = {i: sum(100 * len(s & k) >= num * len(s | k) for k in kinds if s and k and k != s) for i, s in enumerate(sets)}
    found = ngram_join.NgramJoin(docs_of(spark, texts, partitions=3), n, num, 100, block_ngrams=block)
    rows = found.components().collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == want and max(want.values()) > 5
    plain = ngram_join.NgramJoin(docs_of(spark, texts, partitions=3), n, num, 100, block_ngrams=block, counted=False)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in plain.components().collect())
    assert got == brute_components(texts, n, num, 100)


def test_keep_one(spark):
    rnd = random.Random(1)
    texts = family(rnd, 6, 100, 1) + ["quite another text of more than five words"] + [None, None]
    docs = docs_of(spark, texts)
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i, _, c in brute_components(texts, 5, 80, 100) if i == c}


def test_null_and_repeated_ids(spark):
    docs = docs_of(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (None, "x y z"), (4, "p q"), (4, "p q")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.NgramJoin(docs).components().collect()), key=repr)
    assert got == [(3, 3), (4, 4), (4, 4), (None, 3), (None, None)]


def test_bounds_hold_for_every_pair_of_sizes():
    for num in (50, 80, 90):
        for a in range(1, 300):
            for b in range(a, a * 100 // num + 1):
                overlap = -(-num * (a + b) // (100 + num))
                assert overlap >= ngram_join.least_overlap(b, num, 100) >= ngram_join.least_overlap(a, num, 100)
                both = min(ngram_join.due(a), ngram_join.due(b))
                assert overlap >= both >= max(ngram_join.due(ngram_join.least_overlap(x, num, 100)) for x in (a, b))


@pytest.mark.parametrize("counted", [True, False])
def test_small_pieces(spark, monkeypatch, counted):
    monkeypatch.setattr(ngram_join, "LEAST_NGRAMS", 300)
    rnd = random.Random(9)
    texts = family(rnd, 50, 60, 6) + family(rnd, 30, 40, 30) + family(rnd, 12, 90, 2)
    rows = ngram_join.NgramJoin(docs_of(spark, texts, partitions=3), 3, 60, 100, counted=counted).components().collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components(texts, 3, 60, 100)


def test_long_texts_and_clashing_columns(spark):
    texts = [" ".join(f"w{i}" for i in range(60_000)), " ".join(f"w{i}" for i in range(59_990)), "a " * 50_000]
    names = ("key", "held", "rank", "block", "weight", "rep", "node", "component", "mark1", "a", "b", "n")
    docs = docs_of(spark, texts).withColumns({c: F.lit("x") for c in names})
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.NgramJoin(docs).components().collect()) == [(0, 0), (1, 0), (2, 2)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_long_words_of_two_letters_differ():
    one = "a"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    for n in (64, 65, 1024, 2048, 4096):
        pair = [one[:n].encode(), one[:n].translate(str.maketrans("ab", "ba")).encode()]
        hashes, _ = words.hashed([*pair, pair[0].upper()])
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_word_hashes():
    texts = [b"One two\x0bTHREE  four", b"", b"\xc3\x89 \xc3\xa9", b"one two three four"]
    hashes, at = words.hashed(texts)
    assert list(at) == [0, 4, 4, 6, 10] and list(hashes[:4]) == list(hashes[6:]) and hashes[4] != hashes[5]
    assert [len(s) for s in words.shingle_sets(texts, 3)] == [2, 0, 1, 2]


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = Components({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    used = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: found.find(x) for x in used}


# Lines.


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, line, edits):
    own = list(line)
    for _ in range(edits):
        kind, at = rnd.random(), rnd.randrange(len(own))
        if kind < 0.3:
            own.pop(at)
        elif kind < 0.6:
            own.insert(at, rnd.choice("abcé"))
        else:
            own[at] = rnd.choice("abcé")
    return "".join(own)


def line_distance(a, b):
    """(edit distance, most that links) of two lines."""
    one, other = (a.split(" "), b.split(" ")) if min(len(a.split(" ")), len(b.split(" "))) >= 10 else (a, b)
    return distance(one, other), min(2, min(len(one), len(other)) // 10)


def kept_places(texts):
    first = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(dict.fromkeys(x for x in (t or "").split("\n") if x.strip(" \t\r\f\x0b"))):
            first.setdefault(x, (d, i))
    names = sorted(first, key=first.get)
    found = Components(range(len(names)))
    for i, a in enumerate(names):
        for j in range(i):
            d, most = line_distance(a, names[j])
            if d <= most:
                found.join(i, j)
    return {first[names[i]] for i in range(len(names)) if found.find(i) == i}, len(names)


@pytest.mark.parametrize("hot", [8, 2])
def test_lines_same_as_brute_force(spark, hot):
    rnd = random.Random(hot)
    bases = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(8, 40))).strip().ljust(8, "x") for _ in range(12)]
    texts = ["\n".join(edited(rnd, rnd.choice(bases), rnd.randint(0, 4)) for _ in range(4)) for _ in range(40)] + [None, "", "\n \n", "short\nshort\nshorz", "shorz"]
    for length in (9, 10, 11, 19, 20, 21, 22, 60):
        base = [rnd.choice(["the", "of", "é", "", "house", "tree"]) + rnd.choice(["", "s"]) for _ in range(length)]
        for _ in range(6):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(own))
                own[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["new"], ["very", "new"]])
            texts.append("x " + " ".join(own))
    own = line_dedup.LineDedup(docs_of(spark, texts), k=2, hot=hot)
    kept, lines = kept_places(texts)
    assert len(kept) < lines
    rows = {r["doc_id"]: r for r in own.counts().collect()}
    assert {(i, p) for i, r in rows.items() for p in r["kept_lines"]} == kept
    assert len(rows) == len(texts) and rows[43]["n_lines"] == 3 and rows[43]["n_kept"] == 2 and rows[44]["n_kept"] == 0 and rows[40]["n_lines"] == 0


@pytest.mark.parametrize("hot", [8, 2])
def test_crowded_lines_same_as_brute_force(spark, hot):
    rnd = random.Random(hot)
    lines = []
    for size in (12, 22, 40):
        base = [f"w{i}" for i in range(size)]
        for version in (base, [*base[:-3], "x1", "x2", "x3"], ["a"] * size, ["a", "b"] * (size // 2)):
            for _ in range(14):
                own = list(version)
                for _ in range(rnd.randint(0, 4)):
                    at = rnd.randrange(size // 3, len(own) - 1)
                    own[at : at + rnd.randint(0, 2)] = rnd.choice([[], ["t1"], ["t2", own[at]], [own[at + 1], own[at]], [f"n{rnd.randrange(30)}"]])
                lines.append(" ".join(own))
    lines += [f"Order {rnd.randrange(1000)} was sent {rnd.randrange(100)}" for _ in range(40)]
    rnd.shuffle(lines)
    own = line_dedup.LineDedup(docs_of(spark, lines), k=2, hot=hot)
    assert {(r["doc_id"], p) for r in own.counts().collect() for p in r["kept_lines"]} == kept_places(lines)[0]


def test_candidates_of_a_template_grow_with_its_lines(spark, monkeypatch):
    rnd, met, write = random.Random(1), [], scratch.materialize

    def counted(df, name):
        found = write(df, name)
        met.extend([found.count()] if name == "line-pairs" else [])
        return found

    monkeypatch.setattr(scratch, "materialize", counted)
    number = lambda: rnd.randrange(10**6)
    texts = [f"Order {number()} of {number()} was shipped to the customer in the town {number()} on a day of this month and paid" for _ in range(300)]
    rows = line_dedup.LineDedup(docs_of(spark, texts)).counts().collect()
    assert sum(r["n_kept"] for r in rows) == len(kept_places(texts)[0])
    assert sum(met) < 10 * len(texts)


def test_blank_lines_stay(spark):
    texts = ["first\n\nsecond", "\t\nfirst\n \n", "third\n\nthird\nfirst"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.LineDedup(docs_of(spark, texts)).texts().collect()}
    assert got == {0: texts[0], 1: "\t\n \n", 2: "third\n"}


def test_lines_of_null_and_repeated_ids(spark):
    texts = [(None, "only here\nshared"), (None, "also alone"), (5, "shared\nfive"), (5, "other five\nshared\nfive\nlast"), (-(2**63), "first"), (2**63 - 1, "first\nmost"), (7, "twice"), (7, "twice")]
    own = line_dedup.LineDedup(docs_of(spark, texts).withColumns({c: F.lit(1) for c in ("doc", "line", "lines", "all", "mark", "id")}))
    rows = own.counts().collect()
    assert len(rows) == 8 and sorted(r["n_kept"] for r in rows if r["doc_id"] == 7) == [0, 1]
    assert sorted((r["n_lines"], r["n_kept"], r["doc_id"]) for r in rows if r["doc_id"] not in (None, 5, 7)) == [(1, 1, -(2**63)), (2, 1, 2**63 - 1)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in own.texts().collect())
    rest = [(0, "only here"), (0, "also alone"), (-(2**63), "first"), (2**63 - 1, "most"), (7, "twice")]
    one = [(5, "shared\nfive"), (5, "other five\nlast")]
    two = [(5, ""), (5, "other five\nshared\nfive\nlast")]
    assert got in (sorted(rest + one), sorted(rest + two))


def test_registered_line_query_finds_a_replaced_word(spark, tmp_path):
    words = [f"word{i}" for i in range(33)]
    texts = [" ".join(words), " ".join([*words[:9], "another", *words[10:]]), "Contact us now", "Contact us naw", "Page 1", "Page 2", " ".join(words * 3000), " ".join(words * 3000 + ["end"])]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["n_near"] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert rows == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}


def test_banded_distance(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(800):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(4, 14)))
        b = edited(rnd, a, rnd.randint(0, 3))
        if len(a) < len(b):
            a, b = b, a
        rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d long")
    for k in (1, 2, 3):
        own = df.filter(F.length("a") - F.length("b") <= k).withColumn("x", line_dedup.banded_distance(line_dedup.chars(F.col("a")), line_dedup.chars(F.col("b")), k))
        assert own.filter(F.col("x") != F.least("d", F.lit(k + 1))).count() == 0
        cut = own.filter("a <> b").withColumn("t", line_dedup.trimmed(F.col("a"), F.col("b")))
        assert cut.filter(line_dedup.banded_distance(line_dedup.chars(F.col("t.x")), line_dedup.chars(F.col("t.y")), k) != F.col("x")).count() == 0
        assert cut.filter("t.x <> '' and t.y <> '' and (left(t.x, 1) = left(t.y, 1) or right(t.x, 1) = right(t.y, 1))").count() == 0


def test_no_python_on_the_native_paths(spark):
    docs = docs_of(spark, ["a\nb", "a\nb"])
    for df in (exact_dedup.exact_groups(docs), line_dedup.LineDedup(docs).counts()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
