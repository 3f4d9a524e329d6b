"""Shared helpers: tables written to the cluster's checkpoint folder, appended columns, folds of doc_id."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FALLBACK = "/tmp/checkpoints"
#: Frees the shuffle files of a write when it ends, not when the driver's heap is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on one machine (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{_FALLBACK}"


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared checkpoint folder and reads it back: the lineage ends there, and a lost
    executor costs no more than a read. The shuffles behind it are freed at once, as nothing reads them again. The files
    go by ``release`` or with the folder, which the cluster's owner cleans. batch_rows: rows of a batch that goes to
    Python, where single rows are long."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables. All that was made of them must be written by then, for no plan can
    read them again, not even to make up for a lost executor."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("lexloom-"):
                raise ValueError(f"{folder} is no materialized table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str, of: str | None = None) -> Column:
    """The column of this very name, whatever it holds; of: a struct that it is a field of."""
    whole = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{whole}" if of else whole)


def add_columns(df: DataFrame, source: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with new columns that ``work`` computes from the column ``source``, batch by batch, without a shuffle.

    A column of df with the name of a new one is replaced; all others pass through unread.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    if source not in keep:
        raise ValueError(f"column {source} is missing or would be replaced")
    # one struct, as mapInArrow can't name columns with dots
    others = F.struct(F.lit(0).alias("_"), *[quoted(c) for c in keep if c != source]).alias("_row")
    kept = df.select(others, quoted(source).alias("_source"))
    places = [f"_new{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(1))], names=["_row", "_source", *places])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(places, fields, strict=True))])
    whole = kept.mapInArrow(run, schema)
    return whole.select(*[F.col("_source").alias(c) if c == source else quoted(c, "_row") for c in keep], *[F.col(n).alias(f.name) for n, f in zip(places, fields, strict=True)])


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


#: Most bytes of text that a fit takes to the driver, over all classes.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows_per_class: int, values: tuple = (0, 1), most_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """At most rows_per_class labelled texts of each class and most_bytes in all, the same in every run: [(text, label)].

    Only ids are ordered (by a hash, so that any order of arrival gives the same rows); the texts of the chosen ids, a
    bounded number, come by a broadcast join. A doc_id that stands in docs several times gives one text, the first by hash,
    with partial sums, so a hot id is a few rows in the shuffle. A class ends where its share of most_bytes is passed; its
    first text is always taken.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*values) & allowed).groupBy("doc_id").agg(F.min(label).alias("_y"))
    chosen = None
    for value in values:
        part = one.where(F.col("_y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = materialize(met.groupBy("doc_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text")))
    left = {value: most_bytes / len(values) for value in values}
    wanted = []
    for doc_id, y, size in sorted(rows.select("doc_id", "_y", F.octet_length("text"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").drop("h").collect(), key=lambda r: r[1]):
        if left[y] > 0:
            wanted.append(doc_id)
        left[y] -= size
    some = rows if min(left.values(), default=0) >= 0 else rows.where(F.col("doc_id").isin(wanted))
    out = [(r["text"], int(r["_y"])) for r in some.orderBy("doc_id").collect()]
    release(rows)
    return out
