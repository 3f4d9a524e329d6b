"""Incremental indexing of a stream of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources import tables


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("file_name"), tables.content_hash(F.col("text")).alias("file_hash"))


def run_available(spark: SparkSession, folder: str) -> DataFrame:
    """Reads what documents are there as a stream, appends their manifest rows, and returns the manifest."""
    at = f"{tables.shared_folder(spark)}/lexloom-stream-{uuid.uuid4().hex}"
    path = f"{folder}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # as a glob, so that a table may be one file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")
    done = manifest(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("collection string, file_name string, file_hash string").parquet(f"{at}/out")


def cost_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Calls and latency of each node in tumbling windows; with a watermark, so state is bounded on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("latency")).select(F.col("window.start").alias("start"), "event_type", "calls", "latency")
