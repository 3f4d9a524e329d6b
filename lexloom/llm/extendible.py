"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of the key. Rows' bytes are summed by cells of the hash (the first level has
about four cells a shard's bytes); of the tree of prefixes above the cells, a bucket is a prefix that fits the byte limit
and whose parent doesn't, so only oversized buckets are split on another bit. Cells that exceed the limit themselves are split
further, ``STEP`` bits a level, until each bucket fits. A cell of one hash alone can't be split: its rows (a hot key) are cut
into chunks of whole rows, and a single row over half the limit has a shard of its own.

The directory is a table, from cells of each level to buckets, and never comes to the driver: its size follows total bytes /
limit. Rows meet it by their cell, level by level; a level of up to ``BROADCAST_ROWS`` cells is broadcast, a larger one is
joined in a shuffle. Bytes are summed with partial sums over a narrow table (hash, size) that is written once, without a
shuffle, so that texts are read for their length once.

Defined results: a null text has 0 bytes; a null key hashes as text "\\0null"; an empty table has no shards and no rows;
repeated rows stay together unless they exceed the limit; very long texts have a shard of their own; ties (a bucket of just
the limit) fit; columns named like the results (shard_id, depth, n_bytes) are replaced, all others pass, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.store import materialize, quoted

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
STEP = 4
BITS = 62
BROADCAST_ROWS = 500_000
#: Rows of a hot key that are cut into chunks in one task.
CUT_ROWS = 1 << 18
RESULTS = ("shard_id", "depth", "n_bytes")


@dataclass
class Directory:
    """For each level its bits and a table (cell, prefix, depth, bytes, whole): the bucket of each cell; whole: one hash that
    exceeds the limit."""

    levels: list[tuple[int, DataFrame]]
    limit: int

    def buckets(self) -> DataFrame | None:
        """(prefix, depth, bytes, whole) of all buckets."""
        out = None
        for _, level in self.levels:
            part = level.select("prefix", "depth", "bytes", "whole").distinct()
            out = part if out is None else out.unionByName(part)
        return out


def hash_of(key: str):
    """BITS bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(quoted(key).cast("string"), F.lit("\0null"))), 64 - BITS)


def size_of(text: str):
    return F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long")


def build(rows: DataFrame, limit: int = SHARD_BYTES) -> Directory:
    """The directory for rows (_h, _size), which are read once a level."""
    total = rows.agg(F.sum("_size")).first()[0]
    if total is None:
        return Directory([], limit)
    bits = min(BITS, max(0, int(np.ceil(np.log2(max(1, total / limit))))) + 2) if total > limit else 0
    levels: list[tuple[int, DataFrame]] = []
    part, above = rows, 0
    while True:
        cells = part.groupBy(F.shiftrightunsigned("_h", BITS - bits).alias("cell")).agg(F.sum("_size").alias("bytes"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        cells = materialize(cells)
        # the prefixes from the level above (known to exceed the limit, but for the root) down to the cells
        tree = cells.select("bytes", "cell", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")).select("depth", F.expr(f"shiftrightunsigned(cell, {bits} - depth)").alias("prefix"), "bytes")
        tree = materialize(tree.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")))
        over = tree.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        children = tree.where(F.col("bytes") <= limit).withColumn("up", F.shiftrightunsigned("prefix", 1))
        leaves = children.join(over, ["depth", "up"], "left_semi").select("depth", "prefix", "bytes")
        if above == 0:
            leaves = leaves.unionByName(tree.where((F.col("depth") == 0) & (F.col("bytes") <= limit)).select("depth", "prefix", "bytes"))
        full = F.col("bytes") > limit
        single = (F.col("lo") == F.col("hi")) | F.lit(bits >= BITS)
        own = cells.where(~full).select("cell", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
        entries = own.join(leaves, ["depth", "prefix"]).select("cell", "prefix", "depth", "bytes", F.lit(False).alias("whole"))
        entries = entries.unionByName(cells.where(full & single).select("cell", F.col("cell").alias("prefix"), F.lit(bits).alias("depth"), "bytes", F.lit(True).alias("whole")))
        levels.append((bits, materialize(entries)))
        deeper = materialize(cells.where(full & ~single).select("cell"))
        if deeper.isEmpty():
            return Directory(levels, limit)
        part = materialize(part.withColumn("cell", F.shiftrightunsigned("_h", BITS - bits)).join(_few(deeper), "cell", "left_semi").select("_h", "_size"))
        above, bits = bits, min(BITS, bits + STEP)


def _few(rows: DataFrame) -> DataFrame:
    """Marks a written table for a broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def assign(rows: DataFrame, directory: Directory) -> DataFrame:
    """rows (_row, _h, _size) with shard_id (text: the bits of the prefix, "-" and a chunk number where a key was cut), depth and
    n_bytes, and the columns of _row."""
    found, prefix, depth, whole = rows, [], [], []
    for k, (bits, level) in enumerate(directory.levels):
        named = level.select(F.col("cell").alias(f"_c{k}"), F.struct("prefix", "depth", "whole").alias(f"_b{k}"))
        found = found.withColumn(f"_c{k}", F.shiftrightunsigned("_h", BITS - bits)).join(_few(named), f"_c{k}", "left")
        prefix.append(F.col(f"_b{k}.prefix"))
        depth.append(F.col(f"_b{k}.depth"))
        whole.append(F.col(f"_b{k}.whole"))
    if not directory.levels:
        prefix, depth, whole = [F.lit(0).cast("long")], [F.lit(0)], [F.lit(False)]
    bits_text = F.when(F.col("_depth") > 0, F.lpad(F.bin("_prefix"), F.col("_depth"), F.lit("0"))).otherwise("")
    found = found.select("_row", "_h", F.col("_size").alias("n_bytes"), F.coalesce(*prefix).alias("_prefix"), F.coalesce(*depth).alias("_depth"), F.coalesce(*whole).alias("_whole"))
    found = found.select("_row", "_h", "n_bytes", bits_text.alias("shard_id"), F.col("_depth").cast("int").alias("depth"), "_whole")
    buckets = directory.buckets()
    if buckets is not None and not buckets.where("whole").isEmpty():
        found = _cut(found, directory.limit)
    return found.select(*[quoted(c, "_row") for c in rows.schema["_row"].dataType.names], "shard_id", "depth", "n_bytes")


def _cut(found: DataFrame, limit: int) -> DataFrame:
    """Chunks of the rows of each key that no bit can split: parts of about CUT_ROWS rows, in each runs of whole rows of half
    the limit, so that a run with its last row fits; larger rows stand alone. The parts are written down before they are
    cut, so a lost executor can't deal rows anew."""
    whole = found.where("_whole")
    sizes = whole.groupBy("_h").agg(F.count(F.lit(1)).alias("_k")).select("_h", F.ceil(F.col("_k") / CUT_ROWS).alias("_parts"))
    dealt = whole.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "_h")
    dealt = materialize(dealt.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.pmod(F.xxhash64("_n"), "_parts")))
    before = Window.partitionBy("_h", "_part", "_large").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    run = F.when(F.col("_large"), F.concat(F.lit("x"), F.col("_n").cast("string"))).otherwise(F.floor(F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) / (limit / 2)).cast("string"))
    narrow = dealt.select("_h", "_part", "_n", "n_bytes", (F.col("n_bytes") * 2 > limit).alias("_large")).withColumn("_run", run).select("_n", "_run")
    cut = dealt.join(narrow, "_n").withColumn("shard_id", F.concat_ws("-", "shard_id", F.col("_part").cast("string"), "_run"))
    return cut.select(found.columns).unionByName(found.where("not _whole"))


def shard(docs: DataFrame, key: str = "doc_id", size: str = "text", limit: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with shard_id, depth and n_bytes."""
    kept = [c for c in (keep or docs.columns) if c not in RESULTS]
    rows = docs.select(F.struct(*[quoted(c) for c in kept]).alias("_row"), hash_of(key).alias("_h"), size_of(size).alias("_size"))
    return assign(rows, build(materialize(rows.select("_h", "_size")), limit))
