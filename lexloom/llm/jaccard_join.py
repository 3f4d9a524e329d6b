"""Exact n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

1. *Classes.* Each text becomes the sorted set of its 64-bit shingle hashes; texts with equal sets (a 128-bit digest
   and the size) are one class, named by its smallest doc_id. Copies are not compared again.
2. *Tiles.* In the order of the hashes, the first ``n - ceil(t n) + 1`` shingles of a set of n are its prefix; two sets
   of similarity t or more share a shingle of their prefixes. A shingle found in the prefixes of two classes or more
   makes tiles, one for each size band (a band spans the factor 1/t): a class is at home in its own band's tile and a
   guest in the next band's, so sets too unlike in size never meet.
3. *Bitmaps.* A class has a bitmap of a power of two of bits, at least twice its size: each shingle flips the bit of
   its hash. The bits in which two bitmaps (the wider one folded) differ are at most the shingles in one set only,
   which bounds the overlap from above; pairs below the bound for t go.
4. *Exact step.* The rest is decided on the sorted arrays.

Shingles found in the prefixes of the same classes (the shingles of a passage that many texts share) make the same tiles;
one of them is kept. Not all pairs of a tile are compared at once either. A star round compares each class with leaders of
its tile; linked classes become one component. A last step compares, in each tile, the members outside of its largest
component with all others, across components, so a group of thousands of near copies costs a few comparisons a member and
no link between components is lost. A shingle whose tile would still take more than ``HOT_PAIRS`` comparisons is put last
in the order of shingles: the prefixes of the texts that hold it are extended by as many others, which are tested for heat
in their turn (``HOT_ROUNDS``). The order of shingles is free, so this changes the work and never the result; of more
than ``HOT_SHINGLES`` the hottest are put last, the others' tiles are compared as they are.

Defined results: null and empty texts (no words) have an empty set and are linked with nothing; fewer than five words
are one shingle, the whole sequence; repeated rows are one document, and a doc_id with several texts is a document of each
text; a null doc_id is its own document with a null component; an empty table gives no rows; extra columns, whatever their
names, play no part. doc_id is a whole number; other types are an error (ValueError), as a component's id is the least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import textbytes as tb
from lexloom.llm.store import add_columns, materialize, quoted, release

WIDTH = 5
PERCENT = 75
#: 64-bit words of the short bitmap that goes with a class into the tiles' own comparison.
WORDS = 8
#: Comparisons of a tile from which its shingle is put last in the order.
HOT_PAIRS = 4000
#: Rounds in which shingles are put last, and most of them that are broadcast (8 bytes each), the hottest first.
HOT_ROUNDS = 3
HOT_SHINGLES = 1_000_000
#: Most rows of 8 bytes that are broadcast to a join; beyond it Spark chooses, by what it measures.
BROADCAST_ROWS = 500_000
#: Pairs of a batch in the exact step: each brings two arrays, of 160 KB for a text of 20,000 words.
EXACT_ROWS = 256


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a run."""
    data = tb.LOWER[data]
    s, e, first = tb.spans(data, off, tb.NOT_SPACE)
    words = tb.span_hash(tb.prefix_hash(data), s, e)
    h = tb.window_hash(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(h[a : b - width + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            yield tb.window_hash(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(x: np.ndarray) -> bytes:
    bits = max(64, 1 << (2 * len(x) - 1).bit_length()) if len(x) else 64
    flips = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def short_bitmap(x: np.ndarray) -> list[int]:
    """The bitmap at a fixed width of WORDS * 64 bits, as signed words."""
    flips = np.bincount((x & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def linked(inter: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (n + m - inter)


def _digest(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(tb.mix(x).sum().astype(np.int64)), int(tb.mix(x ^ tb.MULTIPLIERS[50]).sum().astype(np.int64))


def sketch(docs: DataFrame, with_prefix: bool, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, d1, d2 of each row; with_prefix: also the bitmaps and the prefix."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
    if with_prefix:
        fields += [T.StructField("bits", T.BinaryType()), T.StructField("short", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))]

    def work(column: pa.Array) -> list[pa.Array]:
        sizes, d1, d2, bits, short, prefix, lengths = [], [], [], [], [], [], []
        for _, _, data, off in tb.runs(column):
            for x in shingle_sets(data, off):
                a, b = _digest(x)
                sizes.append(len(x))
                d1.append(a)
                d2.append(b)
                if with_prefix:
                    k = prefix_length(len(x), percent)
                    p = x[:k]
                    bits.append(bitmap(x))
                    short.append(short_bitmap(x))
                    prefix.append(p)
                    lengths.append(len(p))
        out = [pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]
        if with_prefix:
            joined = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            out += [pa.array(bits, pa.binary()), pa.array(short, pa.list_(pa.int64())), tb.list_array(joined.astype(np.int64), np.array(lengths, np.int64), pa.int64())]
        return out

    return add_columns(docs.select("doc_id", "text"), "text", fields, work).drop("text")


def extensions(docs: DataFrame, hot, percent: int = PERCENT) -> DataFrame:
    """(shingle, doc_id, n): what prefixes have besides their first one's shingles that aren't hot, where the shingles of the
    broadcast sorted array ``hot`` come last in the order."""

    def work(column: pa.Array) -> list[pa.Array]:
        sizes, parts = [], []
        for _, _, data, off in tb.runs(column):
            for x in shingle_sets(data, off):
                sizes.append(len(x))
                parts.append(_extension(x, prefix_length(len(x), percent), hot.value))
        joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return [pa.array(sizes, pa.int64()), tb.list_array(joined.astype(np.int64), np.array([len(p) for p in parts], np.int64), pa.int64())]

    added = add_columns(docs.select("doc_id", "text"), "text", [T.StructField("n", T.LongType()), T.StructField("added", T.ArrayType(T.LongType()))], work)
    return added.select(F.explode("added").alias("shingle"), "doc_id", "n")


def _extension(x: np.ndarray, k: int, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
    is_hot = hot[at] == x
    if not is_hot[:k].any():
        return x[:0]
    order = np.concatenate([np.flatnonzero(~is_hot), np.flatnonzero(is_hot)])[:k]
    return x[order[(order >= k) | is_hot[order]]]


def _band(n: str):
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")


def shared_postings(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shingle, c, n) -> the same of one shingle of each set of classes (two or more) that share it, and
    (shingle, kept): all shared shingles, each with the one that stands for its set.

    Counts and digests of the sets come first, with partial sums, so a shingle of a hot group is a few rows in the shuffle;
    only then are the postings of the kept ones picked by a join, whose skew adaptive execution can split.
    """
    sets = flat.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit("set"), "c")).alias("y")).where("lo < hi")
    groups = materialize(sets)
    one = groups.groupBy("lo", "hi", "k", "x", "y").agg(F.min("shingle").alias("kept"))
    named = materialize(groups.join(one, ["lo", "hi", "k", "x", "y"]).select("shingle", "kept"))
    kept = named.where("shingle = kept").select("shingle")
    return materialize(flat.join(_small(kept), "shingle", "left_semi")), named


def _small(rows: DataFrame) -> DataFrame:
    """Marks written rows of 8 bytes for a broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _size_fits(n: str, m: str):
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


class Verifier:
    """Decides pairs of classes: bitmaps first, then the sorted arrays of those classes that are still in question."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int = PERCENT):
        self.docs, self.percent = docs, percent
        self.bits = classes.select("c", "n", "bits")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose bitmaps allow a link."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n, m, x, y = batch.columns
                ok = []
                for p, q, u, v in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True):
                    # at most (n + m - differing) / 2 shingles are in both
                    ok.append(linked((p + q - differing_bits(u, v)) // 2, p, q, percent))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

        left = self.bits.select(F.col("c").alias("a"), "n", F.col("bits").alias("x"))
        right = self.bits.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        both = pairs.join(left, "a").join(right, "b").where(_size_fits("n", "m")).select("a", "b", "n", "m", "x", "y")
        return both.mapInArrow(run, "a long, b long")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(c, s): the sorted arrays of the classes in pairs."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = self.docs.select("doc_id", "text").join(needed, "doc_id")

        def arrays(column: pa.Array) -> list[pa.Array]:
            found = [x for _, _, data, off in tb.runs(column) for x in shingle_sets(data, off)]
            joined = np.concatenate(found) if found else np.zeros(0, np.uint64)
            return [tb.list_array(joined.astype(np.int64), np.array([len(x) for x in found], np.int64), pa.int64())]

        return add_columns(texts, "text", [T.StructField("s", T.ArrayType(T.LongType()))], arrays).select(F.col("doc_id").alias("c"), "s")

    def exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [linked(overlap(x.values.to_numpy(), y.values.to_numpy()), len(x.values), len(y.values), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        near = materialize(self.near(pairs))
        sets = materialize(self.sets(near))
        found = materialize(self.exact(near, sets), EXACT_ROWS)
        release(near, sets)
        return found


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays (of the bit patterns of unsigned hashes)."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def components(links: DataFrame) -> DataFrame:
    """(c, comp): the smallest class that each class of links (a, b) reaches; classes without links are left out.

    Large-star and small-star steps by turns until nothing changes; each turn's edges are written to the checkpoint
    folder. No edge list or component is held in one task or on the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = materialize(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        old, edges = edges, materialize(small)
        release(old)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == before:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct())
        before = state


def _with_component(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return postings.withColumn("comp", F.col("c"))
    return postings.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def _star(tiled: DataFrame) -> DataFrame:
    """Pairs of each class with two home classes of its tile, of the least and the greatest component, where they differ."""
    lead = tiled.where("home").groupBy("shingle", "band").agg(F.min(F.struct("comp", "c", "n")).alias("l"), F.max(F.struct("comp", "c", "n")).alias("r"))
    met = tiled.join(lead, ["shingle", "band"])
    both = met.select("c", "n", "comp", F.explode(F.array_distinct(F.array("l", "r"))).alias("x"))
    return _pairs(both.where(F.col("comp") != F.col("x.comp")).select("c", F.col("x.c").alias("d"), "n", F.col("x.n").alias("m")))


def _largest(tiled: DataFrame) -> DataFrame:
    """(shingle, band, major, work) of the tiles with members of several components and a home class: the component with
    most members, and the comparisons of the others with all."""
    sizes = tiled.groupBy("shingle", "band", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("home").alias("owned"))
    tiles = sizes.groupBy("shingle", "band").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("k"), F.max("owned").alias("owned"))
    return tiles.where(F.col("owned") & (F.col("k") > F.col("m.k"))).select("shingle", "band", F.col("m.comp").alias("major"), ((F.col("k") - F.col("m.k")) * F.col("k")).alias("work"))


def _cross(tiled: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a tile's members outside of its largest component with all members of other components, as far as the
    short bitmaps allow.

    The bitmaps are compared inside the join, so a pair that they rule out is never a row.
    """
    mixed = materialize(_largest(tiled))
    words = classes.select("c", *[F.col("short")[i].alias(f"s{i}") for i in range(WORDS)])
    rest = tiled.join(mixed.select("shingle", "band", "major"), ["shingle", "band"])
    rest = materialize(rest.join(words, "c"))
    minor = rest.where("comp != major").select("shingle", "band", F.col("c").alias("d"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("home").alias("owned"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(WORDS)])
    differing = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    # at most (n + m - differing) / 2 shingles are in both
    allowed = (100 - PERCENT) * (F.col("n") + F.col("m")) >= (100 + PERCENT) * differing
    met = rest.join(minor, ["shingle", "band"]).where((F.col("comp") != F.col("other")) & (F.col("home") | F.col("owned")) & _size_fits("n", "m") & allowed)
    return _pairs(met.select("c", "d", "n", "m"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.where(_size_fits("n", "m")).select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def join(docs: DataFrame, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, components): doc_id, n_shingles and class c of each document (c null where the set is empty);
    the verified links (a, b) between classes, which connect all that is linked; (c, comp) of the linked classes.

    A class is named by its least doc_id, so each doc_id must have one text (``component_ids`` sees to it)."""
    docs = docs.select("doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketched = sketch(known, True)
    classes = sketched.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "bits", "short", "prefix")).alias("r"))
    classes = materialize(classes.select(F.col("r.doc_id").cast("long").alias("c"), F.col("n_shingles").alias("n"), "d1", "d2", "r.bits", "r.short", "r.prefix"))
    verifier = Verifier(known.join(classes.select(F.col("c").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]) if _repeats(known) else known.join(classes.select(F.col("c").alias("doc_id")), "doc_id", "left_semi"), classes)
    flat = classes.select(F.explode("prefix").alias("shingle"), "c", "n")
    postings, named = shared_postings(flat)
    seen: DataFrame | None = None
    found: DataFrame | None = None
    comps: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        nonlocal seen, found, comps
        fresh = materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return
        links = verifier.links(fresh)
        seen = fresh if seen is None else seen.unionByName(fresh)
        if links.isEmpty():
            return
        found = links if found is None else found.unionByName(links)
        comps = materialize(components(found))

    compare(_star(_tiled(postings, comps)))
    now, groups = postings, named
    hot: np.ndarray = np.zeros(0, np.uint64)
    for _ in range(HOT_ROUNDS):
        heat = _largest(_tiled(now, comps)).groupBy(F.col("shingle").alias("kept")).agg(F.sum("work").alias("work")).where(F.col("work") > hot_pairs)
        busy = groups.join(heat, "kept").orderBy(F.desc("work"), "shingle").select("shingle").limit(HOT_SHINGLES - len(hot)).toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
        fresh = np.union1d(hot, busy)
        if len(fresh) == len(hot):
            break
        hot = fresh
        shared = docs.sparkSession.sparkContext.broadcast(hot)
        last = _small(docs.sparkSession.createDataFrame(pa.table({"shingle": pa.array(hot.view(np.int64))})))
        cooled = materialize(flat.join(last, "shingle", "left_semi").select(F.col("c").alias("doc_id")).distinct())
        added = materialize(extensions(verifier.docs.join(_small(cooled), "doc_id", "left_semi"), shared).select("shingle", F.col("doc_id").alias("c"), "n"))
        # an added shingle can also stand in a first prefix
        names = _small(added.select("shingle").distinct())
        touched = added.unionByName(flat.join(names, "shingle", "left_semi").join(last, "shingle", "left_anti")).distinct()
        extended, others = shared_postings(touched)
        cold = postings.join(last, "shingle", "left_anti")
        now = materialize(cold.unionByName(extended).distinct())
        groups = named.join(last, "shingle", "left_anti").unionByName(others).distinct()
        release(added, cooled)
    if len(hot):
        compare(_star(_tiled(now, comps)))
    compare(_cross(_tiled(now, comps), classes))
    members = sketch(docs.where(F.col("text").isNotNull()), False).unionByName(docs.where(F.col("text").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("d1"), F.lit(None).cast("long").alias("d2")))
    named = classes.select("c", F.col("n").alias("n_shingles"), "d1", "d2")
    members = members.join(named, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", "c")
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "a long, b long")
    return members, (found if found is not None else empty), (comps if comps is not None else spark.createDataFrame([], "c long, comp long"))


def _tiled(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Tiles with the component of each class."""
    own = _with_component(postings, comps).withColumn("band", _band("n"))
    return own.select("shingle", "c", "n", "comp", F.explode(F.array(F.struct(F.col("band"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))).alias("t")).select("shingle", "t.band", "c", "n", "comp", "t.home")


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty()


def _documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(_key, doc_id, text): documents, each with a key of its own, and whether the keys are other than the doc_ids.

    Only if some doc_id has several rows are texts shuffled, to find its different ones; their keys are written down, so
    that they are the same in every stage that reads them.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _repeats(rows):
        return rows.select(F.col("doc_id").alias("_key"), "doc_id", "text"), False
    once = rows.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return materialize(once.withColumn("_key", F.monotonically_increasing_id()).select("_key", "doc_id", "text")), True


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(_key, n_shingles, comp) of the documents, comp by keys; the documents; whether these have keys of their own."""
    keyed, own = _documents(docs)
    members, _, comps = join(keyed.select(F.col("_key").alias("doc_id"), "text"))
    return members.join(comps, "c", "left").select(F.col("doc_id").alias("_key"), "n_shingles", F.coalesce("comp", "c", "doc_id").alias("comp")), keyed, own


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    members, keyed, own = _members(docs)
    if not own:
        return members.select(F.col("_key").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"))
    named = materialize(members.join(keyed, "_key"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    rows = named.join(least, "comp").select("doc_id", "text", "n_shingles", "component_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alone = sketch(ids.where("doc_id is null"), False).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    met = ids.where("doc_id is not null").alias("i").join(rows.alias("r"), (F.col("i.doc_id") == F.col("r.doc_id")) & F.col("i.text").eqNullSafe(F.col("r.text")))
    return met.select("r.doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, of its texts the first by hash, of equal rows the
    first by the hash of all columns. What is linked with nothing stays (an id with two such texts keeps both), and all
    rows without doc_id."""
    members, keyed, own = _members(docs)
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    alone = rows.where("_id is null").select("_row")
    if not own:
        first = members.where("_key = comp").select(F.col("_key").alias("_id"))
        return rows.where("_id is not null").join(first, "_id", "left_semi").select("_row").unionByName(alone).select("_row.*")
    named = members.join(keyed, "_key")
    first = materialize(named.groupBy("comp").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"), "_key")).alias("f")).select("f.*"))
    met = rows.alias("i").join(first.alias("f"), (F.col("_id") == F.col("f.doc_id")) & F.col("_text").eqNullSafe(F.col("f.text")))
    once = met.groupBy("_id", "_text").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return once.select("_row").unionByName(alone).select("_row.*")
