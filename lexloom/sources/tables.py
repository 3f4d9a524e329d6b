"""Tables of a folder, and SQL over them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, statement: str) -> DataFrame:
    """A statement over the folder's tables; only those that it names are opened."""
    used = {n: read(spark, folder, n) for n in NAMES if re.search(rf"\b{n}\b", statement)}
    for name, df in used.items():
        statement = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", statement)
    return spark.sql(statement, **used)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of folder/<collection>/<file> that aren't hidden: collection, file_name, file_type, content, file_hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("collection"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    kind = F.when(extension == "pdf", "pdf").when(extension.isin("html", "htm"), "html")
    return named.where(~F.col("file_name").startswith(".")).select("collection", "file_name", kind.alias("file_type"), "content", content_hash(F.col("content")).alias("file_hash"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only on one machine, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its plan ends there, and lost executors don't recompute it."""
    path = f"{shared_folder(df.sparkSession)}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
