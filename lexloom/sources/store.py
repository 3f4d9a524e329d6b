"""A store of chunks in Parquet that is only ever appended to, with incremental indexing of files.

A write is a version: its rows, its removals and, last, its line in ``commits``. Readers see the versions that are there
in ``commits`` from the last compacted one on, less rows that a later version removes; a write cut short is never seen.
One writer at a time; readers need no lock. Rows are sorted by collection and file, so filters skip row groups.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import search

FILE = ["collection", "file_name"]
_SCHEMAS = {"files": "collection string, file_name string, file_hash string, version long", "removed": "collection string, file_name string, chunk_id string, version long", "commits": "version long, base boolean"}


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, chunk_schema: str):
        """chunk_schema: DDL with collection, file_name, chunk_id, chunk_index, text and any metadata."""
        self.spark, self.path = spark, path.rstrip("/")
        self._schemas = _SCHEMAS | {"chunks": f"{chunk_schema}, version long"}
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for name, schema in self._schemas.items():  # an empty part, so that every table can be read
            if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame, version: int) -> None:
        columns = self.spark.createDataFrame([], self._schemas[name]).columns
        rows = rows.withColumn("version", F.lit(version)).select(*columns)
        if name != "commits":
            rows = rows.sortWithinPartitions(*FILE)
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _commit(self, version: int, base: bool = False) -> None:
        self._append("commits", self.spark.range(1).select(F.lit(base).alias("base")), version)

    def _live(self, name: str) -> DataFrame:
        commits = self._read("commits")
        last = commits.where("base").agg(F.max("version")).first()[0] or 0  # one value
        seen = commits.where(F.col("version") >= last).select("version")
        rows = self._read(name).where(F.col("version") >= last).join(seen, "version", "left_semi")
        gone = self._read("removed").where(F.col("version") >= last).join(seen, "version", "left_semi")
        c, r = rows.alias("c"), gone.alias("r")
        same = (F.col("c.collection") == F.col("r.collection")) & (F.col("c.file_name") == F.col("r.file_name")) & (F.col("r.version") > F.col("c.version"))
        one = F.col("r.chunk_id").isNull()
        if name == "chunks":
            one = one | (F.col("r.chunk_id") == F.col("c.chunk_id"))
        return c.join(r, same & one, "left_anti")

    def chunks(self, **conditions) -> DataFrame:
        return self._live("chunks").where(search.predicate(**conditions)).drop("version")

    def files(self) -> DataFrame:
        """The manifest: collection, file_name, file_hash."""
        return self._live("files").drop("version")

    def count(self, **conditions) -> int:
        return self.chunks(**conditions).count()

    def get_chunks(self, wanted: DataFrame) -> DataFrame:
        """Chunks at positions. wanted: collection, file_name, chunk_index."""
        return self.chunks().join(wanted.select(*FILE, "chunk_index").distinct(), [*FILE, "chunk_index"], "left_semi")

    def get_texts(self, chunk_ids: DataFrame) -> DataFrame:
        return self.chunks().select("chunk_id", "text").join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def upsert(self, chunks: DataFrame) -> None:
        """Chunks by id, in place of those with the same id. The rows are read twice, so their plan must be stable."""
        version = time.time_ns()
        self._append("removed", chunks.select(*FILE, "chunk_id"), version)
        self._append("chunks", chunks, version)
        self._commit(version)

    def delete_files(self, files: DataFrame) -> None:
        version = time.time_ns()
        self._append("removed", files.select(*FILE, F.lit(None).cast("string").alias("chunk_id")), version)
        self._commit(version)

    def index(self, docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """Brings the store to docs (collection, file_name, file_hash, ...) and returns (collection, file_name, state).

        state: skipped (same hash), new, changed, or removed: no longer among docs, in collections that docs name.
        chunker takes the new and changed docs. All of it becomes visible at once.
        """
        version = time.time_ns()
        now = docs.select(*FILE, F.col("file_hash").alias("_new"))
        known = self.files().withColumnRenamed("file_hash", "_old").join(now.select("collection").distinct(), "collection", "left_semi")
        skips = (F.col("_old") == F.col("_new")) & F.lit(not force)
        state = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "new").when(skips, "skipped").otherwise("changed")
        plan = f"{self.path}/reports/{version}"
        now.join(known, FILE, "full_outer").select(*FILE, state.alias("state"), F.col("_new").alias("file_hash")).write.parquet(plan)
        report = self.spark.read.parquet(plan)
        fresh = report.where("state IN ('new', 'changed')")
        self._append("removed", report.where("state IN ('changed', 'removed')").withColumn("chunk_id", F.lit(None).cast("string")), version)
        self._append("chunks", chunker(docs.join(fresh.select(*FILE), FILE, "left_semi")), version)
        self._append("files", fresh, version)
        self._commit(version)
        return report.select(*FILE, "state")

    def compact(self) -> None:
        """Writes what is live as one version; earlier ones aren't read any more and may be deleted."""
        version = time.time_ns()
        for name in ("chunks", "files"):
            self._append(name, self._live(name).drop("version").repartitionByRange(*FILE), version)
        self._commit(version, base=True)
