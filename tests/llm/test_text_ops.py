"""Classifier, shards, media, packing, WARC, mixing and HTML extraction: brute force, round trips, held-out accuracy."""

import hashlib
import wave
import gzip
import io
import json
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetql.llm import encoding, html_extract, html_tree, media, mixing, packing, quality, queries, scratch, token_shards, warc

from .util import SF, docs_of, duck

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGES = [None, "", " ", "a", "Ein langer Text. " * 3000, "É " * 50, "x", "x", "<|endoftext|> y", "a  b\n\n c "]


def encode(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


# Encoding.


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_is_the_librarys(path):
    own = encoding.Encoder(path, words=50, pieces=70)
    plain = own.tokenizer

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["the ", " it's", "'ll", "  ", "\n", "été ", "12", "!?", "<|endoftext|>", "İ", "ß,", "\x85", "  "])), max_size=8))
    def check(parts):
        text = "".join(parts)
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids

    check()


# Token shards.


@given(st.sets(st.integers(-(2**62), 2**62), max_size=400), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_perfect_hash_is_minimal(keys, extra):
    keys = np.array(sorted(keys), np.int64)
    _, _, slot, _ = token_shards.build_index(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))


def test_shard_round_trip():
    out = io.BytesIO()
    writer = token_shards.ShardWriter(out, 2)
    rows = [(None, [1, 2]), (-5, [3]), (7, []), (7, [4, 4]), (9, [5])]
    for key, ids in rows:
        writer.add(key, np.array(ids, "<u2").tobytes())
    writer.finish()
    shard, file = token_shards.Shard(out.getvalue()), token_shards.ShardFile(pa.BufferReader(out.getvalue()))
    got = {key: [(first, ids.tolist()) for first, ids in file.get(key)] for key in (-5, 0, 7, 8, 9)}
    assert got == {-5: [(2, [3])], 0: [], 7: [(3, []), (3, [4, 4])], 8: [], 9: [(5, [5])]}
    assert shard.places().tolist() == [0, 1, 2, 3, 4]
    assert [shard.ids(i).tolist() for i in range(shard.n_docs)] == [ids for _, ids in rows]
    with pytest.raises(ValueError):
        token_shards.Shard(out.getvalue()[8:])


def test_shards_same_as_brute_force(spark):
    docs = docs_of(spark, [(10 - i, t) for i, t in enumerate(EDGES)] + [(3, "again"), (None, "no key")], partitions=3)
    manifest = token_shards.write_shards(docs, scratch.new_path(spark, "t"), BYTE, 2)
    got = [tuple(r) for r in token_shards.read_shards(spark, manifest, with_ids=True).collect()]
    rows = sorted([(10 - i, t) for i, t in enumerate(EDGES)] + [(3, "again"), (None, "no key")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for key, text in rows:
        ids = [*encode(BYTE, text), 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-40, 40)), st.integers(0, 5)), max_size=60), st.sets(st.integers(-45, 45)))
@settings(max_examples=60, deadline=None)
def test_keyed_reads_same_as_scan(docs, wanted):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out, want, start = io.BytesIO(), {}, 0
    writer = token_shards.ShardWriter(out, 4)
    for i, (key, n) in enumerate(docs):
        writer.add(key, np.full(n, i, "<u4").tobytes())
        want.setdefault(key, []).append((start, [i] * n))
        start += n
    writer.finish()
    file = token_shards.ShardFile(pa.BufferReader(out.getvalue()))
    for key in wanted:
        assert [(first, ids.tolist()) for first, ids in file.get(key)] == want.get(key, [])
    assert token_shards.Shard(out.getvalue()).places().tolist() == list(range(len(docs)))


def test_a_key_takes_as_many_reads_in_any_shard():
    class Counted:
        def __init__(self, data):
            self.data, self.reads = data, []

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.reads.append(n)
            return self.data[at : at + n]

    seen = []
    for n in (10, 5000):
        out = io.BytesIO()
        writer = token_shards.ShardWriter(out, 2)
        for key in range(n):
            writer.add(3 * key, np.array([key % 7] * 4, "<u2").tobytes())
        writer.finish()
        file = Counted(out.getvalue())
        assert token_shards.ShardFile(file).get(12)[0][0] == 16
        seen.append(file.reads)
    assert seen[0] == seen[1] and sum(seen[0]) < 200


def test_documents_by_key(spark):
    rows = [(k % 50 - 20, f"text {k}") for k in range(60)] + [(None, "no key"), (2**40, None)]
    manifest = token_shards.write_shards(docs_of(spark, rows, partitions=3), scratch.new_path(spark, "t"), BYTE, 2)
    every = token_shards.read_shards(spark, manifest, with_ids=True).collect()
    assert len(every) == len(rows)
    keys = [None, 2**40, -20, -20, 7, 99, 2**50]
    got = token_shards.read_keys(manifest, spark.createDataFrame([(k,) for k in keys], "doc_id long")).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for k in keys if k is not None for r in every if r["doc_id"] == k)
    assert token_shards.read_keys([], spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_no_documents_no_shards(spark):
    manifest = token_shards.write_shards(docs_of(spark, []), scratch.new_path(spark, "t"), BYTE, 2)
    assert manifest == [] and token_shards.read_shards(spark, manifest).count() == 0


# Packing.


def test_packing_places_every_id_once(spark):
    texts = EDGES + [f"some words number {i} " * (i % 90) for i in range(400)]
    rows = packing.pack(docs_of(spark, texts, partitions=2), WORD, 2, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == [*encode(WORD, t), 2] and {r["doc_tokens"] for r in own} == {sum(r["length"] for r in own)}
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
    lengths = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        lengths.append(sum(r["length"] for r in own))
    assert all(n == 4096 or n & (n - 1) == 0 and n < 4096 for n in lengths)


def test_packing_keeps_all_limits(spark):
    rnd = random.Random(2)
    texts = ["word " * rnd.randint(0, 70) for _ in range(300)]
    docs = docs_of(spark, texts).withColumn("prompt", F.when(F.col("doc_id") % 2 == 0, F.lit("tell me more")))
    rows = packing.pack(docs, WORD, 2, max_tokens=128, max_segments=3, max_loss=100, prompt_col="prompt", with_ids=True).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        assert sum(r["length"] for r in own) <= 128 and len(own) <= 3 and sum(r["loss_tokens"] for r in own) <= 100
    total = sum(len(encode(WORD, t)) + 1 + 3 * (i % 2 == 0) for i, t in enumerate(texts))
    assert sum(r["length"] for r in rows) == total and sum(r["loss_tokens"] for r in rows) == total - 3 * 150
    assert packing.pack(docs_of(spark, []), WORD, 2).count() == 0


def test_dot_product_heuristic():
    demands = np.array([[6, 1, 6], [5, 1, 1], [4, 1, 4], [5, 1, 5]], float)
    bins = packing.fill_by_dot_product(demands, np.array([10, 4, 10], float))
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3] and len(bins) == 2
    assert all(demands[b].sum(axis=0)[0] <= 10 for b in bins)


# Media.


def png(width=2):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b";"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xx\xff\x00yy\xff\xd0z\xff\xd9"


def ogg():
    head = b"OggS\0\x06" + b"\0" * 8 + b"\1\0\0\0" + b"\0" * 4
    page = bytearray(head + b"\0\0\0\0" + b"\x01\x03abc")
    crc = 0
    for x in page:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ media._ogg_table()[(crc >> 24) ^ x]
    page[22:26] = struct.pack("<I", crc)
    return bytes(page)


def test_sniffing_and_carving():
    samples = {"audio/wav": media.wav_of(b"ab" * 32), "image/png": png(), "image/bmp": BMP, "image/gif": GIF, "image/jpeg": JPEG, "audio/ogg": ogg()}
    blob = b"text BM RIFF "
    want = []
    for kind, data in samples.items():
        assert media.sniff(data, "text/plain") == (kind, [])
        want.append((len(blob), len(data), kind))
        blob += data + b" GIF89a "
    assert [tuple(f) for f in media.carve(blob)] == want
    for kind, data in samples.items():
        assert media.sniff(data[:-3], "x/y")[0] == "x/y", kind
    assert media.sniff(b"", "a/b") == (None, []) and media.sniff(None, "a/b") == (None, []) and media.sniff(b"hello", "a/b") == ("a/b", [])


def test_stored_text_reads_back(spark):
    texts = [*EDGES, "y" * 64, "z" * 65, "RIFF1234WAVE BM \x00"]
    rows = {r["doc_id"]: r for r in media.media_features(media.store_text(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.wav_of(padded)
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, padded)
        own = io.BytesIO()
        with wave.open(own, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(padded)
        assert own.getvalue() == stored
        assert (r["media_bytes"], r["media_sha256"], bytes(media.samples_of(stored))) == (len(stored), hashlib.sha256(stored).hexdigest(), padded)
    assert rows[6]["feature"] == rows[7]["feature"] and json.loads(rows[3]["feature"])["corrected"] is True
    assert media.media_features(media.store_text(docs_of(spark, []))).count() == 0


# WARC.

PAGE = '<html><head><title>A &amp; b</title><script>x<y</script></head><body><p>One<p>Two <a href="/x?a=1&amp;b=2">link</a></body>'


def test_warc_derivatives(spark):
    rows = [(1, "http://a/1", PAGE), (2, None, None), (2, None, None), (None, "http://a/\n2", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    path = scratch.new_path(spark, "warc")
    got = warc.read_records(spark, path, warc.write_derivatives(warc.response_column(pages), path)).collect()
    assert len(got) == 8
    source = warc.response_record(*rows[0])
    own = {r["record_type"]: r for r in got if r["key"] == 1}
    meta, conversion = own["metadata"], own["conversion"]
    assert meta["refers_to"] == conversion["refers_to"] == source.get("WARC-Record-ID")
    assert meta["concurrent_to"] == conversion["record_id"] and conversion["concurrent_to"] == meta["record_id"] and meta["date"] == warc.DATE
    assert bytes(conversion["block"]) == b"One\nTwo link" and conversion["source_payload_digest"] == warc.digest(PAGE.encode())
    facts = json.loads(bytes(meta["block"]))
    assert facts["html"] == {"title": "A & b", "links": ["/x?a=1&b=2"]} and dict(facts["source"]["headers"])["WARC-Record-ID"] == source.get("WARC-Record-ID")
    assert facts["http"]["status"] == "HTTP/1.1 200 OK" and meta["block_digest"] == warc.digest(bytes(meta["block"]))
    assert {r["content_length"] for r in got if r["key"] == 2 and r["record_type"] == "conversion"} == {0}
    assert warc.write_derivatives(warc.response_column(pages.limit(0)), path + "-none") == []


def test_titles_and_links_are_those_of_elements():
    page = """<!-- <a href="/no"> --><svg><title>icon</title><text>s</text></svg><script>'<a href="/no">'</script>
    <title>One
    two</title><a data-href="/no" title="x href='/no'" HREF='/1?a&amp;b'>x</a><area href=/2><link rel=x href="/3"/><a>no</a><title>late</title><textarea><a href="/no">"""
    assert html_tree.title_and_links(page) == ("One two", ["/1?a&b", "/2", "/3"])
    assert html_tree.title_and_links(None) == (None, []) and html_tree.title_and_links("<title>open") == ("open", [])


def test_encoded_payloads():
    body = b"<title>t</title><p>text"
    for head, payload in ((b"", body), (b"Content-Encoding: gzip\r\n", gzip.compress(body)), (b"Transfer-Encoding: chunked\r\n", b"5;x=1\r\n<titl\r\n12\r\ne>t</title><p>text\r\n0\r\n\r\n"), (b"Content-Encoding: gzip\r\n", body)):
        source = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:x>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + payload)
        meta, conversion = warc.derive(source)
        assert conversion.block == b"text" and json.loads(meta.block)["html"]["title"] == "t"


def test_drawn_and_set_text_stays():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><text>label</text></svg> <object>shown</object></p><xmp>as is</xmp>"
    assert html_tree.plain_text(page) == "Let x=1 and label shown\nas is"


def test_warc_parsing():
    record = warc.response_record(1, "http://é", "x" * 10)
    data = warc.to_bytes(record)
    assert list(warc.records_of(data * 2)) == [warc.parse_record(data)[0]] * 2
    back = warc.parse_record(data)[0]
    assert back.block == record.block and back.get("warc-target-uri") == "http://é"
    assert warc.derive(warc.Record([("WARC-Type", "request")], b"")) == []
    for bad in (data[:-1], b"x" + data, data.replace(b"Content-Length: ", b"Content-Length: 9"), b""[:0] + b"WARC/1.1\r\nnocolon\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))


# Mixing.

MIXED = [(i, t) for i, t in enumerate(["a b c", None, "", "d " * 50, "e f", "g", "h i j k", "l " * 9, "m", "m"])]
SOURCES = ["z", "z", None, "a", None, "b", "é", "b", "c", "c"]


def test_mix_same_as_sql(spark):
    docs = docs_of(spark, MIXED, SOURCES)
    con = duck(documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", [(i, t, s) for (i, t), s in zip(MIXED, SOURCES)]))
    got = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert got == sorted(con.execute(queries.OP9_SQL).fetchall())
    taken, target = {}, {}
    for (i, _), s in zip(MIXED, SOURCES):
        row = got[i]
        taken[s], target[s] = taken.get(s, 0) + row[4], row[3]
        assert row[4] <= 2 * row[1]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken) and abs(sum(target.values()) - 1.5 * sum(r[1] for r in got)) < 1e-9


@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 5)), min_size=1, max_size=12), st.floats(0, 2))
@settings(max_examples=200, deadline=None)
def test_water_filling(sources, share):
    sizes, weights = zip(*sources)
    total = share * sum(sizes)
    targets = mixing.water_fill(list(sizes), list(weights), total)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(targets, sizes)) and abs(sum(targets) - total) <= 1e-6 * max(1, total)
    free = [t / w for t, s, w in zip(targets, sizes, weights) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) <= 1e-6 * max(1, max(free))


def test_mix_is_empty_without_rows(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.repeat_rows(docs_of(spark, [])).count() == 0


def test_repeated_rows_hold_the_taken_words(spark):
    docs = docs_of(spark, MIXED, SOURCES)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert (r["text"] or "").split() == (dict(MIXED)[r["doc_id"]] or "").split()[: len((r["text"] or "").split())]
    assert all(words.get(i, 0) == n for i, n in taken.items())


def test_repeated_rows_with_null_and_repeated_ids(spark):
    texts = [(None, "a b c"), (None, "d " * 20), (None, "e f g h"), (7, "i j"), (7, "k " * 15), (7, "l"), (8, "m n o")]
    docs = docs_of(spark, texts, ["s", "s", "s", "t", "t", "t", "t"])
    rows = mixing.mix(docs).collect()
    want = {s: round(next(r["target"] for r in rows if r["source_size"] == n)) for s, n in (("s", 27), ("t", 21))}
    got, seen = {}, {}
    for r in mixing.repeat_rows(docs).collect():
        words = r["text"].split()
        got[r["source"]] = got.get(r["source"], 0) + len(words)
        seen[words[0]] = seen.get(words[0], 0) + len(words)
    assert got == want and set(seen) == set("adeiklm")
    assert all(seen[t.split()[0]] <= 2 * len(t.split()) for _, t in texts)


# Quality.


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}


def test_scores_are_exact_cosine_votes():
    rnd = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked, labels = unit(rnd.standard_normal((50, 6))), unit(rnd.standard_normal((30, 6))), rnd.integers(0, 2, 50).astype(float)
    model = quality.Model(np.arange(6), np.ones(6), np.eye(6, dtype=np.float32), known, labels, 0.5)
    for x, got in zip(asked, model.scores(asked, 5, 2)):
        cosines = known @ x
        near = np.argsort(-cosines)[:5]
        weight = np.maximum(cosines[near], 0) ** 2
        assert abs(got - (weight * labels[near]).sum() / weight.sum()) < 1e-5


def test_quality_edge_cases(spark):
    docs = docs_of(spark, ["", None, " ", "a", "word " * 100_000])
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(rows) == 5 and {r["score"] for r in rows} == {0.5}
    split = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (4, 1, 0), (4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in quality.labelled_ids(split, "doc_id", "quality").collect()} <= {(4, 1)}
    assert quality.score(docs_of(spark, []), quality.fit(docs, none)).count() == 0


# HTML.


def test_reading_html():
    nodes, runs = html_tree.parse("<p>a<b>b</b><p>c&amp;&lt;<br>d<ul><li>e<li>f</ul><script>if (a<b) '</p>'</script><!-- x --><td>g")
    assert [r for _, r in runs] == ["ab", "c&< d", "e", "f", "g"]
    assert [nodes[n].tag for n, _ in runs] == ["p", "p", "li", "li", "td"]
    for odd in (None, "", "<", "<p", "</", "a<b c", "<a href='x", "<script>never ends", "<!-- never ends", "&#x110000; &bogus;", "<p>" * 2000):
        html_tree.parse(odd)
    assert html_tree.plain_text("x <P CLASS=y>Z</p> w") == "x\nZ\nw"


def test_marginals_same_as_enumeration():
    model = html_extract.trained()
    nodes, _ = html_tree.parse('<div class="x"><p>Some text here.</p><nav><a href=q>link</a></nav></div><footer>end</footer>')
    chars, linked = html_tree_totals(nodes)
    n = len(nodes)
    own = [model.prior + sum(model.odds.get(f, 0) for f in html_extract.evidence(x, chars[i], linked[i])) for i, x in enumerate(nodes)]
    weight = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(o for o, v in zip(own, y) if v))
        for i in range(1, n):
            table = model.edges.get(html_extract.GROUPS.get(nodes[i].tag, "other"), model.default)
            w *= table[y[nodes[i].parent]][y[i]]
        total += w
        weight += w * np.array(y)
    assert np.allclose(model.marginals(nodes), weight / total)


def html_tree_totals(nodes):
    return html_extract.totals(nodes)


def test_extraction_on_held_out_pages():
    model = html_extract.trained()
    right = seen = 0
    for nodes, labels in html_extract.labelled_pages(150, seed=99):
        for node, label, p in zip(nodes, labels, model.marginals(nodes)):
            if node.chars:
                seen += 1
                right += (p >= 0.5) == label
    assert right / seen > 0.99


def test_extraction_of_the_pages(spark):
    import html
    import re

    rows = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    source = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", source[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<nav><a href=x>menu</a></nav>")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract(odd).collect()] == ["", "", ""]
