"""Line dedup by a segment-partition edit join (DataFrame functions only).

Lines are what newlines separate.  Blank lines (white space only) are left alone.  Equal lines collapse first.  Two
different lines link when their edit distance is at most one in ten symbols of the shorter one, and at most ``k``; a class
is what links connect.  Symbols are words (what single spaces separate) if both lines have ``MIN_WORDS`` or more, else
characters: a replaced word is one edit in a sentence, a replaced letter is one in a heading.  Of a class one line stays:
that of the smallest document id, there the first one.

1. Index: a line of length l is cut into k + 1 segments as even as possible; each is a key with l and its number.
   k edits leave one segment untouched.
2. Probe: for each length from l - k to l, and each segment, the parts that can equal it: those whose shift is
   explained by fewer edits to the left than segments lie there, and likewise to the right.
3. Candidates share a key.  A key shared by more than ``HOT`` lines is a hot one: its lines meet three pivots only (the
   line that most documents have, the one of least and the one of greatest id).
4. Verification: words that only one line has must not be more than k; then banded bit-parallel edit distance; of
   characters, what two lines have in common at both ends is taken off first.  The band's 2k + 1 cells of a column are bits
   of one number; a column costs a few word operations.  It runs as an ``aggregate`` over the symbols.
5. Components of the links (see ``components``).
6. Lines of a hot key outside the component that most of its lines are in are outsiders; other components of the key may
   still link with them.  They meet by finer keys: k edits spoil at most qk of a line's different runs of q symbols, so of
   the first qk + r runs of two such lines, in one order for all, at least r are the same.  The order puts runs that no
   pivot of the key has first, so what a line shares with the whole key does not count while it has enough of its own.
   An outsider chooses between single words and pairs of neighbours (r = 1); characters go by pairs, two at once (r = 2).
7. A finer key of more than ``HOT`` lines has three pivots again.  Whatever lines of a finer key are then in different
   components meet behind a filter of counts (16 classes of symbols, of which 2k counts at most can differ).  That leaves
   no link between two components unseen.

Documents are told apart by id and text.  Rows equal in both are one document: the first of them has its counts, the
others keep nothing, and ``texts`` has it once.  Null ids come last in the order of documents; among equal ids the text's
hash decides.  Null and empty texts have no lines, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

HOT = 8
CLASSES = 16
MIN_WORDS = 10
PER_EDIT = 10
BLANK = " \t\r\f\x0b"


def places(k: int, probe: bool) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift) of the keys of a line in a band of distance k."""
    out = []
    for d in range(k + 1 if probe else 1):
        for i in range(k + 1):
            low, high = (max(-i, d - (k - i)), min(i, d + (k - i))) if probe else (0, 0)
            out += [(d, i, s) for s in range(low, high + 1)]
    return out


def band_places(band: int, by_words: bool, k: int, probe: bool) -> Column:
    """``places`` as an array of structs, with the band's number and the symbols it is compared by."""
    listed = (f"named_struct('band', {band}, 'words', {by_words}, 'k', {k}, 'd', {d}, 'i', {i}, 's', {s})" for d, i, s in places(k, probe))
    return F.expr(f"array({', '.join(listed)})")


def key_at(t: Column) -> Column:
    """The key of a line's part: of a row that has the line's columns and a place t, so that generated code makes it.

    Its lowest bit tells words from characters.
    """
    own = F.when(t["words"], F.col("n_words")).otherwise(F.col("n")) - t["d"]
    start, end = (F.call_function("div", own * i, t["k"] + 1).cast("int") for i in (t["i"], t["i"] + 1))
    cut = lambda how, sign: F.xxhash64(t["band"], own, t["i"], F.call_function(how, F.col(sign), start + t["s"] + 1, end - start))
    return F.when(t["words"], cut("slice", "codes").bitwiseOR(F.lit(1))).otherwise(cut("substring", "head").bitwiseAND(F.lit(-2)))


def pairs_of(symbols: Column) -> Column:
    """Hashes of the different pairs of neighbours, the last one with nothing."""
    return F.array_distinct(F.zip_with(symbols, F.slice(symbols, F.lit(2), F.size(symbols)), lambda x, y: F.xxhash64(x, y)))


def finer_keys(q: int, runs: Column, usual: Column, most: Column, together: int) -> Column:
    """Keys of a line under a hot key: lines of at most ``most`` edits that have the key share one of them.

    They are made of its first runs of q symbols, those that aren't usual first, ``together`` at once.  A line of too few
    different runs has one key more, which all such lines have.
    """
    ordered = F.concat(F.sort_array(F.array_except(runs, usual)), F.sort_array(F.array_intersect(runs, usual)))
    first = F.slice(ordered, F.lit(1), most * q + together)
    keys = F.transform(first, lambda x: F.xxhash64(F.col("key"), F.lit(q), x))
    if together == 2:
        keys = let(keys, lambda own: F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.xxhash64(x, y)))))
    few = F.when(F.size(runs) < most * q + together, F.array(F.xxhash64(F.col("key"), F.lit(-q)))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(keys, few)


def _packed(counts: list[Column]) -> list[Column]:
    """Two numbers of eight bytes each: counts modulo 256."""
    packed = []
    for half in (counts[:8], counts[8:]):
        total = half[0] % 256
        for i, c in enumerate(half[1:], 1):
            total = total.bitwiseOR(F.shiftleft(c % 256, 8 * i))
        packed.append(total)
    return packed


def char_counts(line: Column) -> list[Column]:
    """How often characters of each class occur."""
    groups = ["eE", "aAàáâãäåoOòóôõö", "iIìíîïuUùúûü", "nN", "rR", "sSßtT", "hHdDlLcC", "mMfFpPgGwWyYbBvVkKxXjJqQzZ .,", *"01234567"]
    return _packed([(F.length(line) - F.length(F.translate(line, signs, ""))).cast("long") for signs in groups])


def code_counts(codes: Column) -> list[Column]:
    """How often words of each class occur; a word's class are the low bits of its hash."""
    classes = F.transform(codes, lambda c: c.bitwiseAND(F.lit(CLASSES - 1)))
    return _packed([F.size(F.filter(classes, lambda x: x == i)).cast("long") for i in range(CLASSES)])  # noqa: B023  used at once


def count_gap(a: list[Column], b: list[Column]) -> Column:
    """A lower bound of the sum of count differences."""
    total = F.lit(0).cast("long")
    for x, y in zip(a, b):
        for i in range(8):
            d = F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * i).bitwiseAND(F.lit(255))
            d = F.abs(d)
            total = total + F.least(d, F.lit(256) - d)
    return total


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of arrays a and b (not shorter than b, by k at most) if it is at most k, else k + 1."""
    width = 2 * k + 1
    full = (1 << width) - 1
    long_, short, m, n = a, b, F.size(a), F.size(b)
    bits = lambda x: F.lit(x).cast("long")
    none = F.lit(None).cast("string")
    # For each column the cells of the band whose characters match: one comparison of the arrays for each of its diagonals.
    match = None
    for o in range(width):
        moved = F.concat(F.array_repeat(none, k - o), long_) if o < k else F.slice(long_, F.lit(o - k + 1), m + 1)
        bit = bits(1 << o)
        cells = F.zip_with(short, moved, lambda x, y: F.when(x == y, bit).otherwise(bits(0)))  # noqa: B023  used at once
        match = cells if match is None else F.zip_with(match, cells, lambda x, y: F.coalesce(x, bits(0)).bitwiseOR(F.coalesce(y, bits(0))))

    def step(state: Column, match: Column) -> Column:
        vp, vn, left = state["vp"], state["vn"], state["left"]
        d0 = match.bitwiseAND(vp) + vp
        d0 = d0.bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(bits(full))
        hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(bits(full)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        # Down the band's edge while it lies above the last row (left > 0), then along that row.
        at = F.greatest(F.lit(width - 2) + left, F.lit(0))
        sign = lambda x, p: F.call_function("shiftrightunsigned", x, p).bitwiseAND(bits(1))
        more = F.when(left > 0, bits(1) - sign(d0, F.lit(width - 1))).otherwise(sign(hp, at) - sign(hn, at))
        return F.struct(
            hn.bitwiseOR(down.bitwiseOR(hp).bitwiseXOR(bits(full))).bitwiseAND(bits(full)).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (state["dist"] + more).alias("dist"),
            (left - 1).alias("left"),
        )

    start = F.struct(bits(full - (1 << k) + 1).alias("vp"), bits(0).alias("vn"), F.least(bits(k), m.cast("long")).alias("dist"), (m - k).alias("left"))
    walked = F.aggregate(F.slice(match, F.lit(1), n), start, step)
    return F.when(n == 0, m.cast("long")).otherwise(F.least(walked["dist"], bits(k + 1)))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of what two different strings have in common at the start, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(29, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, w: p + F.when(F.substring(a, p + 1, w) == F.substring(b, p + 1, w), w).otherwise(F.lit(0)))


def trimmed(a: Column, b: Column) -> Column:
    """(x, y): two different strings without their common start and end, backwards; their edit distance is the same."""
    whole = F.lit(2**31 - 1)
    rests = let(common_prefix(a, b), lambda p: F.struct(F.reverse(F.substring(a, p + 1, whole)).alias("x"), F.reverse(F.substring(b, p + 1, whole)).alias("y")))
    return let(
        rests,
        lambda r: let(
            common_prefix(r["x"], r["y"]), lambda p: F.struct(F.substring(r["x"], p + 1, whole).alias("x"), F.substring(r["y"], p + 1, whole).alias("y"))
        ),
    )


def chars(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, ""))


def words(line: Column) -> Column:
    return F.split(line, " ")


class LineDedup:
    def __init__(self, docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, min_words: int = MIN_WORDS):
        if not 1 <= k <= 8 or min_words < PER_EDIT:
            raise ValueError("the distance is 1 to 8, and lines compared by words have ten at least")
        self.k, self.hot, self.min_words = k, hot, min_words
        text = F.coalesce(F.col(text_col), F.lit(""))
        mark = F.pmod(F.xxhash64(text), F.lit(10**18))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), mark.cast("decimal(18,0)").alias("mark"))
        # Id, then the text's hash; a decimal can be aggregated by hash, a struct can't.
        rank = F.coalesce(F.col("doc_id").cast("decimal(19,0)") * F.expr(f"CAST({10**18} AS DECIMAL(19,0))"), F.expr(f"CAST({93 * 10**35} AS DECIMAL(38,0))"))
        self.docs = rows.select("doc_id", F.split("text", "\n").alias("all"), (rank.cast("decimal(38,0)") + F.col("mark")).cast("decimal(38,0)").alias("doc"))
        self.docs = self.docs.withColumn("lines", F.filter("all", lambda x: F.btrim(x, F.lit(BLANK)) != ""))
        self.lines = self._distinct()
        self.classes = self._classes()

    def _distinct(self) -> DataFrame:
        """(id, line, n_words, head, codes, doc, place, docs): each different line, with the first document that has it and its place there.

        ``head`` is the line if it can be compared by characters, ``codes`` are its words' hashes if it can be by words.
        """
        each = self.docs.select("doc", F.posexplode(F.array_distinct("lines")).alias("place", "line"))
        found = each.groupBy("line").agg(F.min("doc").alias("doc"), F.expr("min_by(place, doc)").alias("place"), F.count(F.lit(1)).alias("docs"))
        found = found.withColumn("id", F.monotonically_increasing_id()).withColumn("codes", F.transform(words(F.col("line")), lambda w: F.hash(w)))
        found = found.withColumn("n_words", F.size("codes"))
        found = found.withColumn("head", F.when(F.col("n_words") < self.min_words + self.k, F.col("line")))
        return scratch.materialize(found.withColumn("codes", F.when(F.col("n_words") >= self.min_words, F.col("codes"))), "lines")

    def _keys(self, probe: bool) -> DataFrame:
        """(id, docs, key) of all lines, for the bands of one distance each that a line's length lies in.

        For the probe, a line as much as k longer than a band's belongs to it too.  A repetitive line may have a key twice.
        """
        rows = self.lines.select("id", "docs", "head", F.length("head").cast("int").alias("n"), "codes", "n_words")
        bands = []
        for by_words, sign, length in ((False, "head", "n"), (True, "codes", "n_words")):
            for k in range(1, self.k + 1):
                held = F.col(sign).isNotNull() & (F.col(length) >= PER_EDIT * k)
                if k < self.k:
                    held = held & (F.col(length) < PER_EDIT * (k + 1) + k * probe)
                listed = band_places(len(bands), by_words, k, probe)
                bands.append(F.when(held, listed).otherwise(F.slice(listed, 1, 0)))
        return rows.withColumn("t", F.explode(F.concat(*bands))).select("id", "docs", key_at(F.col("t")).alias("key"))

    def _met(self) -> DataFrame:
        """(a, b, key): lines a that share a key with b; the key if it is hot, else null."""
        index = scratch.materialize(self._keys(False), "line-index")
        held = index.groupBy("key").agg(
            F.count(F.lit(1)).alias("held"), F.expr("max_by(id, docs)").alias("p1"), F.min("id").alias("p2"), F.max("id").alias("p3")
        )
        hot = scratch.materialize(held.filter(F.col("held") > self.hot).drop("held"), "line-hot")
        self.crowd = scratch.materialize(index.join(scratch.sized(hot.select("key")), "key", "left_semi").select("key", "id"), "line-crowd")
        calm = index.join(scratch.sized(hot.select("key")), "key", "left_anti").select("key", F.col("id").alias("b"), F.lit(False).alias("hot"))
        self.pivots = hot.select("key", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("b"))
        pivots = self.pivots.withColumn("hot", F.lit(True))
        probe = self._keys(True).select(F.col("id").alias("a"), "key")
        met = probe.join(calm.unionByName(pivots), "key").filter(F.col("hot") | (F.col("a") != F.col("b")))
        return scratch.materialize(met.select("a", "b", F.when(F.col("hot"), F.col("key")).alias("key")), "line-met")

    def _labelled(self, rows: DataFrame, linked: DataFrame) -> DataFrame:
        """The rows (key, id, ...) of keys whose lines are in several components, with their component and the key's main one."""
        rows = rows.join(scratch.sized(linked.withColumnRenamed("node", "id")), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        rows = scratch.materialize(rows, "line-named")
        counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"))
        main = counts.groupBy("key").agg(F.expr("max_by(label, held)").alias("main"), F.count(F.lit(1)).alias("labels"))
        return rows.join(scratch.sized(scratch.materialize(main.filter("labels > 1").drop("labels"), "line-main")), "key")

    def _merged(self, linked: DataFrame, links: DataFrame) -> DataFrame:
        """The components (node, component) when the links count too: those of components are few."""
        if links.isEmpty():
            return linked
        for side in "ab":
            own = scratch.sized(linked.select(F.col("node").alias(side), "component"))
            links = links.join(own, side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        more = scratch.materialize(connected_components(links), "line-components")
        least = scratch.sized(more.select(F.col("node").alias("component"), F.col("component").alias("least")))
        old = linked.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        return scratch.materialize(old.unionByName(more.join(scratch.sized(linked.select("node")), "node", "left_anti")), "line-components")

    def _finer(self, met: DataFrame, linked: DataFrame, lines: DataFrame) -> DataFrame:
        """(key, id, label, held, chose) by finer keys; held: the line has the hot key itself; chose: an outsider that goes by this key."""
        held = self.crowd.withColumn("held", F.lit(True))
        rows = met.filter("key is not null").select("key", F.col("a").alias("id")).distinct().join(held, ["key", "id"], "left")
        rows = scratch.materialize(self._labelled(rows.withColumn("held", F.col("held").isNotNull()), linked), "line-outside")
        pivots = self.pivots.join(scratch.sized(rows.select("key").distinct()), "key", "left_semi")
        runs = self._runs(lines)
        kinds = ("w1", "w2", "c2")
        usual = pivots.join(runs, F.col("b") == F.col("id")).groupBy("key")
        usual = usual.agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"usual_{c}") for c in kinds])
        usual = scratch.sized(scratch.materialize(usual, "line-usual"), 1000)
        rows = rows.join(runs, "id").join(usual, "key")
        by_words = F.col("key").bitwiseAND(F.lit(1)) == 1
        own = lambda c: F.size(F.array_except(c, f"usual_{c}"))
        single = by_words & (own("w2") <= 2 * F.col("most_w")) & (own("w1") > F.col("most_w"))
        none = F.array().cast("array<bigint>")
        ones = F.when(by_words, finer_keys(1, F.col("w1"), F.col("usual_w1"), F.col("most_w"), 1)).otherwise(none)
        twos = F.when(by_words, finer_keys(2, F.col("w2"), F.col("usual_w2"), F.col("most_w"), 1))
        twos = twos.otherwise(finer_keys(2, F.col("c2"), F.col("usual_c2"), F.col("most_c"), 2))
        rows = rows.select("id", "label", "held", (F.col("label") != F.col("main")).alias("out"), single.alias("single"), ones.alias("ones"), twos.alias("twos"))
        told = lambda keys, chosen: F.transform(keys, lambda x: F.struct(x.alias("key"), (F.col("out") & chosen).alias("chose")))
        rows = rows.select("id", "label", "held", F.explode(F.concat(told("ones", F.col("single")), told("twos", ~F.col("single")))).alias("t"))
        return scratch.materialize(rows.select("t.key", "id", "label", "held", "t.chose"), "line-finer")

    def _outside(self, met: DataFrame, linked: DataFrame) -> DataFrame:
        """The components (node, component) when lines of a hot key that are in different ones have met."""
        # Lines of hot keys are read from all lines once.
        lines = self._texts(met.filter("key is not null").select(F.col("a").alias("id")), "line", "docs", "n_words", "head", "codes")
        lines = scratch.materialize(lines, "line-crowded")
        rows = self._finer(met, linked, lines)
        own = F.struct("id", "label")
        held = rows.join(scratch.sized(lines.select("id", "docs")), "id").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.max("chose").alias("chose"), F.max_by(own, F.col("docs")).alias("p1"), F.min(own).alias("p2"), F.max(own).alias("p3")
        )
        # A key of one line, or that no outsider goes by, tells nothing.
        held = scratch.materialize(held.filter("n > 1 and chose").drop("chose"), "line-finer-keys")
        rows = scratch.materialize(rows.join(scratch.sized(held.select("key")), "key", "left_semi"), "line-finer")
        if rows.isEmpty():
            return linked
        pivots = held.filter(F.col("n") > self.hot).select("key", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("b"))
        starred = rows.join(scratch.sized(pivots), "key").filter(F.col("label") != F.col("b.label"))
        links = scratch.materialize(self._near(starred.select(F.col("id").alias("a"), F.col("b.id").alias("b")), lines), "line-links")
        linked = self._merged(linked, links)
        rows = self._labelled(rows.drop("label"), linked)
        rows = scratch.materialize(rows.join(self._counted(lines), "id"), "line-outside")
        found = None
        chose = rows.filter("chose")
        for one, other in ((chose.filter("label <> main"), rows), (chose.filter("label = main"), rows.filter("label <> main"))):
            p, x = one.alias("p"), other.alias("x")
            on = (F.col("p.key") == F.col("x.key")) & (F.col("p.label") != F.col("x.label")) & (F.col("p.held") | F.col("x.held"))
            for kind in "wc":
                gap = count_gap([F.col(f"p.{kind}1"), F.col(f"p.{kind}2")], [F.col(f"x.{kind}1"), F.col(f"x.{kind}2")])
                # No counts: the line isn't compared by such symbols.
                on = on & (F.coalesce(gap, F.lit(0)) <= 2 * self.k)
            pairs = p.join(x, on).select(F.col("p.id").alias("a"), F.col("x.id").alias("b"))
            found = pairs if found is None else found.unionByName(pairs)
        return self._merged(linked, scratch.materialize(self._near(found, lines), "line-links"))

    def _runs(self, lines: DataFrame) -> DataFrame:
        """(id, most_w, w1, w2, most_c, c2): the most edits of words and of characters, the different words, pairs of words and of characters."""
        most = lambda n: F.least(F.lit(self.k), F.floor(n / PER_EDIT)).cast("int")
        single = F.array_distinct(F.transform("codes", lambda c: c.cast("long")))
        rows = lines.select(
            "id", most(F.col("n_words")).alias("most_w"), single.alias("w1"), pairs_of(F.col("codes")).alias("w2"), most(F.length("head")).alias("most_c"), pairs_of(chars(F.col("head"))).alias("c2")
        )
        return scratch.materialize(rows, "line-runs")

    def _texts(self, ids: DataFrame, *columns: str) -> DataFrame:
        """(id, *columns) of the lines asked for."""
        wanted = scratch.sized(scratch.materialize(ids.distinct(), "line-ids"))
        return self.lines.select("id", *columns).join(wanted, "id", "left_semi")

    def _counted(self, lines: DataFrame) -> DataFrame:
        """(id, w1, w2, c1, c2): packed counts of words and characters, null where a line isn't compared by them alone."""
        by_words = F.col("n_words") >= self.min_words + self.k
        both = [F.when(by_words, c) for c in code_counts(F.col("codes"))] + [F.when(F.col("n_words") < self.min_words, c) for c in char_counts(F.col("head"))]
        return scratch.materialize(lines.select("id", *[c.alias(name) for c, name in zip(both, ("w1", "w2", "c1", "c2"))]), "line-counts")

    def _linked(self) -> DataFrame:
        """(node, component) of the lines that link with any."""
        met = self._met()
        links = scratch.materialize(self._near(met.filter("a <> b").select("a", "b"), self.lines), "line-links")
        linked = scratch.materialize(connected_components(links), "line-components")
        return linked if self.crowd.isEmpty() else self._outside(met, linked)

    def _near(self, pairs: DataFrame, lines: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link; their lines are among ``lines``."""
        pairs = scratch.materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
        texts = lines.select("id", "line", "n_words")
        if lines is self.lines:
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
            texts = scratch.materialize(self._texts(ids, "line", "n_words"), "line-texts")
        sides = [texts.select(*[F.col(c).alias(f"{side}_{c}") for c in texts.columns]) for side in "ab"]
        found = pairs.join(sides[0], F.col("a") == F.col("a_id")).join(sides[1], F.col("b") == F.col("b_id"))
        by_words = F.least("a_n_words", "b_n_words") >= self.min_words
        size = lambda side: F.when(by_words, F.col(f"{side}_n_words")).otherwise(F.length(f"{side}_line"))
        found = found.withColumn("most", F.least(F.lit(self.k), F.floor(F.least(size("a"), size("b")) / PER_EDIT)).cast("int"))
        found = found.filter(F.abs(size("a") - size("b")) <= F.col("most"))
        # The longer one first.
        swap = size("a") < size("b")
        x, y = (F.when(swap, F.col(f"{one}_line")).otherwise(F.col(f"{other}_line")) for one, other in ("ba", "ab"))
        of = lambda cut, x, y: F.struct(cut(x).alias("x"), cut(y).alias("y"))
        symbols = F.when(by_words, of(words, x, y)).otherwise(let(trimmed(x, y), lambda t: of(chars, t["x"], t["y"])))
        # Symbols that only one line has are counted first.
        only = lambda one, other: F.size(F.array_except(one, other)) <= F.col("most")
        near = lambda t: only(t["x"], t["y"]) & only(t["y"], t["x"]) & (banded_distance(t["x"], t["y"], self.k) <= F.col("most"))
        return found.filter(let(symbols, near)).select("a", "b")

    def _classes(self) -> DataFrame:
        """(id, doc, place, class, kept): the class of each different line."""
        linked = self._linked()
        rows = self.lines.select("id", "doc", "place").join(scratch.sized(linked), self.lines["id"] == linked["node"], "left")
        rows = scratch.materialize(rows.withColumn("class", F.coalesce("component", "id")).drop("node", "component"), "line-classes")
        groups = rows.join(scratch.sized(linked.select(F.col("component").alias("class")).distinct()), "class", "left_semi")
        best = groups.groupBy("class").agg(F.min(F.struct("doc", "place", "id")).alias("b"))
        best = scratch.sized(scratch.materialize(best, "line-best"))
        return rows.join(best, "class", "left").withColumn("kept", F.coalesce(F.col("b.id"), F.col("id")) == F.col("id")).drop("b")

    def counts(self) -> DataFrame:
        """One row per row of the table: doc_id, n_lines, n_distinct, n_kept, n_near (lines given up for a near copy), kept_lines."""
        every = self._counts().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        none = {"n_kept": F.lit(0).cast("long"), "n_near": F.lit(0).cast("long"), "kept_lines": F.array().cast("array<int>")}
        held = [F.when(F.col("copy") == 1, F.col(c)).otherwise(none[c]).alias(c) if c in none else F.col(c) for c in every.columns]
        return every.select(*held).drop("doc", "copy", "copies")

    def _counts(self) -> DataFrame:
        kept = self.classes.groupBy(F.col("doc").alias("holder")).agg(
            F.sum(F.col("kept").cast("long")).alias("k"), F.sum((~F.col("kept")).cast("long")).alias("near"), F.sort_array(F.collect_list(F.when(F.col("kept"), F.col("place")))).alias("places")
        )
        own = self.docs.select("doc", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("n_distinct"))
        own = own.groupBy("doc", "doc_id").agg(F.max("n_lines").alias("n_lines"), F.max("n_distinct").alias("n_distinct"), F.count(F.lit(1)).alias("copies"))
        return own.join(kept, own["doc"] == kept["holder"], "left").select(
            "doc", "copies", "doc_id", "n_lines", "n_distinct", F.coalesce("k", F.lit(0)).alias("n_kept"), F.coalesce("near", F.lit(0)).alias("n_near"), F.coalesce("places", F.array().cast("array<int>")).alias("kept_lines")
        )

    def texts(self) -> DataFrame:
        """(doc_id, text): the kept lines and the blank ones, in order; one row per document."""
        rows = self.docs.dropDuplicates(["doc"]).join(self._counts().select(F.col("doc").alias("holder"), "kept_lines"), F.col("doc") == F.col("holder"))
        kept = F.transform("kept_lines", lambda i: F.get(F.array_distinct(F.col("lines")), i))
        rows = rows.select("doc_id", "all", kept.alias("kept"))
        stays = lambda x, i: (F.btrim(x, F.lit(BLANK)) == "") | (F.array_contains("kept", x) & (F.array_position("all", x) == i + 1))
        return rows.select("doc_id", F.array_join(F.filter("all", stays), "\n").alias("text"))
