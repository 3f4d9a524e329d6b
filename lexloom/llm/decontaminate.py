"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Items and documents are lower-cased (A-Z) and cut into words; every window of ``n`` item words (an item of fewer
words is one window) is hashed. Each task slides windows over its documents, looks them up in the sorted hashes,
verifies a hit against the window's own bytes, and marks the words inside. The benchmark is broadcast as arrays (hashes, places,
the items' words), in blocks of at most ``BLOCK_BYTES`` of distinct item text, about six times that when built. One block
takes one narrow pass. A benchmark of more blocks takes a pass for each, one after another, so that one block is in memory at
a time; a pass writes the hits of the texts it found, which are joined to the documents by a digest of the text.

Defined results: null and empty texts have no words and are clean; items without words match nothing; an empty
benchmark leaves all clean; repeated rows are judged alike; repeated items count each item_id once; an item_id that
is null is left out of the ids but its windows still mark words; very long texts are scanned whole; an empty table gives no
rows; columns of docs named like the results are replaced, all others pass, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import textbytes as tb
from lexloom.llm.store import add_columns, materialize, quoted

WINDOW = 10
BLOCK_BYTES = 16 << 20


class Windows:
    """The windows of a block of items: for each length the sorted hashes with the place of a window of each, and its items.

    The items' words stand end to end in ``words``, parted by single spaces, so a window is a slice of it.
    """

    def __init__(self, items: list[tuple], n: int = WINDOW):
        self.ids = np.array([str(i) if i is not None else "" for i, _ in items], object)
        self.named = np.array([i is not None for i, _ in items], bool)
        raw, starts, ends, owner, hashes = [], [], [], [], []
        at = 0
        for k, (_, text) in enumerate(items):
            data = tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            s, e, _ = tb.spans(data, np.array([0, len(data)], np.int64), tb.ALNUM)
            if not len(s):
                continue
            bytes_ = data.tobytes()
            line = b" ".join(bytes_[i:j] for i, j in zip(s, e, strict=True))
            hashes.append(tb.span_hash(tb.prefix_hash(data), s, e))
            width = e - s
            begin = at + np.concatenate([[0], np.cumsum(width + 1)[:-1]])
            starts.append(begin)
            ends.append(begin + width)
            owner.append(np.full(len(s), k, np.int32))
            raw.append(line)
            at += len(line) + 1
        self.words = b" ".join(raw)
        #: length of window -> sorted hashes, start and end of a window of each, first of its owners, owners
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(n, len(h)) for h in hashes}):
            mine = [i for i, h in enumerate(hashes) if min(n, len(h)) == k]
            h = np.concatenate([tb.window_hash(hashes[i], k) for i in mine])
            begin = np.concatenate([starts[i][: len(hashes[i]) - k + 1] for i in mine])
            end = np.concatenate([ends[i][k - 1 :] for i in mine])
            who = np.concatenate([owner[i][: len(hashes[i]) - k + 1] for i in mine])
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
            h, who, begin, end = h[fresh], who[fresh], begin[order][fresh], end[order][fresh]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            self.tables[k] = h[first], begin[first], end[first], np.append(first, len(h)).astype(np.int64), who

    @property
    def n_bytes(self) -> int:
        return len(self.words) + sum(x.nbytes for t in self.tables.values() for x in t) + 64 * len(self.ids)

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Words of each document, flags of the hit words with each document's first word, and its items."""
        data = tb.LOWER[data]
        s, e, first = tb.spans(data, off, tb.ALNUM)
        doc = tb.per_document(first)
        words = tb.span_hash(tb.prefix_hash(data), s, e)
        hit, items = np.zeros(len(s) + 1, np.int64), {}
        raw = None
        for k, (hashes, begin, end, owned, who) in self.tables.items():
            if len(s) < k:
                continue
            h = tb.window_hash(words, k)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero((hashes[at] == h) & (doc[: len(h)] == doc[k - 1 :])).tolist():
                raw = data.tobytes() if raw is None else raw
                j = at[i]
                if self.words[begin[j] : end[j]] == b" ".join(raw[a:b] for a, b in zip(s[i : i + k], e[i : i + k], strict=True)):
                    hit[i] += 1
                    hit[i + k] -= 1
                    items.setdefault(int(doc[i]), set()).update(self.ids[x] for x in who[owned[j] : owned[j + 1]] if self.named[x])
        return first, np.cumsum(hit[:-1]) > 0, items


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in lists of about block_bytes of text each, by a hash of the text; the driver holds one list at a time."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=str)


def _scanned(docs: DataFrame, items: list[tuple], n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, n))

    def work(column: pa.Array) -> list[pa.Array]:
        counts, places, lengths, ids, id_lengths = [], [], [], [], []
        for _, _, data, off in tb.runs(column):
            first, hit, found = shared.value.scan(data, off)
            counts.append(np.diff(first))
            at = np.flatnonzero(hit)
            places.append(at - first[np.searchsorted(first, at, "right") - 1])
            lengths.append(tb.sums(hit, first))
            for d in range(len(off) - 1):
                own = sorted(found.get(d, ()))
                ids += own
                id_lengths.append(len(own))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return [pa.array(join(counts), pa.int64()), tb.list_array(join(places), join(lengths), pa.int32()), tb.list_array(ids, id_lengths, pa.string())]

    return add_columns(docs, "text", FIELDS, work)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_words (places of words inside windows) and item_ids (as strings, sorted)."""
    parts = blocks(benchmark, block_bytes)
    items, more = next(parts), next(parts, None)
    if more is None:
        return _scanned(docs, items, n)
    digest_ = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("hits"), "text").alias("b"), F.octet_length("text").alias("n"))
    kept = [c for c in docs.columns if c not in {f.name for f in FIELDS}]
    rows = docs.select(F.struct(*[quoted(c) for c in kept]).alias("_row"), "text")
    found = None
    for block in chain([items, more], parts):
        hits = _scanned(rows.select("text"), block, n).where(F.size("hit_words") > 0)
        hits = materialize(hits.select(digest_.alias("_d"), F.struct("hit_words", "item_ids").alias("h")).groupBy("_d").agg(F.max("h").alias("h")))
        found = hits if found is None else found.unionByName(hits)
    whole = found.select("_d", "h.*").groupBy("_d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    counted = _scanned(rows, [], n).select("_row", "n_words", digest_.alias("_d")).join(materialize(whole), "_d", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return counted.select(*[quoted(c, "_row") for c in kept], "n_words", F.coalesce("hit_words", none("int")).alias("hit_words"), F.coalesce("item_ids", none("string")).alias("item_ids"))


def digest(hits: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the columns of ``find_hits``."""
    return (
        hits.withColumn("n_hit", F.size("hit_words").cast("long"))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256))
        .withColumn("contaminated", F.size("hit_words") > 0)
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window, with docs' own columns."""
    marked = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "text")
    return find_hits(marked, benchmark, n).where(F.size("hit_words") == 0).select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit words cut out of their texts (with what lies between two hit words); the rest stays as it is."""
    marked = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "text")
    hits = find_hits(marked, benchmark, n, block_bytes).select("_row", "hit_words", F.struct("text", "hit_words").alias("_cut"))

    def run(batches):
        for batch in batches:
            texts = [_without(x["text"], x["hit_words"]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    schema = T.StructType([hits.schema["_row"], T.StructField("_text", T.StringType())])
    cut = hits.select("_row", "_cut").mapInArrow(run, schema)
    return cut.select(*[F.col("_text").alias("text") if c == "text" else quoted(c, "_row") for c in docs.columns])


def _without(text: str | None, places: list[int]) -> str | None:
    if not text or not places:
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tb.spans(tb.LOWER[data], np.array([0, len(data)]), tb.ALNUM)
    keep, at, raw = [], 0, data.tobytes()
    runs = np.split(np.array(places), np.flatnonzero(np.diff(places) > 1) + 1)
    for r in runs:
        keep.append(raw[at : s[r[0]]])
        at = e[r[-1]]
    return b"".join([*keep, raw[at:]]).decode()


def sha256_of(item_ids: list) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in item_ids)).encode()).hexdigest()
