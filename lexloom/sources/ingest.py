"""Files to documents: each file is parsed on its own, and what goes wrong with one is a row of the report.

Parsers are functions of a file's bytes, by file type: (content) -> (pages, errors). HTML is built in; a reader of PDF (with OCR
where a page has no text) is passed in by who has such libraries, and its words, spans and tables go through ``operators.layout``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import classify
from lexloom.sources import html, tables

Parser = Callable[[bytes], tuple[list[dict], list[str]]]
PAGES = "array<struct<page: int, text: string, headings: array<string>, tables: array<string>, is_empty: boolean>>"


def parse_html(content: bytes) -> tuple[list[dict], list[str]]:
    return [html.read_page(content.decode("utf-8", "ignore"))], []


PARSERS: dict[str, Parser] = {"html": parse_html}


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """files (collection, file_name, file_type, content, file_hash) with pages and errors. A parser that raises leaves its file
    without pages and its message as an error; a file of no known type has no pages and no error. One narrow pass."""
    known = PARSERS | (parsers or {})

    def one(kind: str | None, content: bytes | None) -> str:
        try:
            pages, errors = known[kind](content or b"") if kind in known else ([], [])
        except Exception as e:  # whatever a parser meets is that file's error
            pages, errors = [], [f"{type(e).__name__}: {e}"]
        return json.dumps({"pages": pages, "errors": errors})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [one(k, c) for k, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(said, pa.string())], names=["collection", "file_name", "file_type", "file_hash", "_said"])

    rows = files.select("collection", "file_name", "file_type", "content", "file_hash").mapInArrow(run, "collection string, file_name string, file_type string, file_hash string, _said string")
    return rows.withColumn("_said", F.from_json("_said", f"pages {PAGES}, errors array<string>")).select("collection", "file_name", "file_type", "file_hash", "_said.*")


def documents(parsed: DataFrame) -> DataFrame:
    """parsed with doc_type, addendum_number, doc_date and title; files without pages aren't documents."""
    texts = F.transform("pages", lambda p: p["text"])
    opening = classify.head(texts)
    rows = parsed.where(F.size("pages") > 0).withColumn("_head", opening).withColumn("doc_type", classify.doc_type(F.col("file_name"), F.col("file_type"), F.col("_head")))
    rows = rows.withColumn("addendum_number", classify.addendum_number(F.col("file_name"), F.col("_head"), F.col("doc_type"))).withColumn("doc_date", classify.doc_date(F.array_join(texts, "\n")))
    return rows.withColumn("title", classify.title(F.transform("pages", lambda p: p["headings"]))).drop("_head")


def report(parsed: DataFrame) -> DataFrame:
    """(collection, file_name, status, pages, empty, errors): skipped (no known type), failed (no pages), partial (errors or
    empty pages) or ok."""
    empty = F.size(F.filter("pages", lambda p: F.coalesce(p["is_empty"], F.trim(p["text"]) == "")))
    status = F.when(F.col("file_type").isNull(), "skipped").when(F.size("pages") == 0, "failed").when((F.size("errors") > 0) | (empty > 0), "partial").otherwise("ok")
    return parsed.select("collection", "file_name", status.alias("status"), F.size("pages").alias("pages"), empty.alias("empty"), "errors")


def ingest(spark: SparkSession, folder: str, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of folder/<collection>/<file>; parsed once, written, and read by both."""
    parsed = tables.written(parse(tables.scan_folder(spark, folder), parsers))
    return documents(parsed), report(parsed)


def save(docs: DataFrame, report_: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("collection").parquet(f"{path}/documents")
    report_.write.mode("overwrite").parquet(f"{path}/report")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents saved before; the report lies beside them and isn't read."""
    return spark.read.parquet(f"{path}/documents")
