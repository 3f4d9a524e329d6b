"""A corpus from raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes all that its predecessor kept, as written Parquet, and all but the last return the columns of documents.

Defined results of every stage: an empty table gives no rows; columns beyond those of documents, whatever their names, pass all
stages but the last; null and empty texts fail the quality rules and go there; very long texts are judged whole; repeated rows
are judged alike; a row without doc_id is a document of its own, which no near duplicate removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, divergence_rules, extendible, jaccard_join, mixing
from lexloom.llm.queries import table
from lexloom.llm.store import materialize, quoted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stray from every language reference go. References are learned from docs itself; a
    null language teaches none. Without any reference the base rules alone decide."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "text")
    return divergence_rules.judge(rows, divergence_rules.learn_references(docs)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that of the smallest doc_id. A doc_id with several texts is a document of
    each, so no text goes that is linked with nothing; of equal rows one stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; with an empty benchmark none does."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the rates that bring the domains' token totals to their targets, or as near as rates can; a row comes
    as often as its rate draws it, by a hash of its doc_id. Without labels all rates are one."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document that is left, a row each: doc_id, shard_id, depth, n_bytes."""
    return extendible.shard(docs, keep=["doc_id"])


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix_to_targets), ("sharding", shards)]

#: Hashes and learned weights are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
