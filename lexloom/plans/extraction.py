"""The extraction loop over many records at once: gather, draft, check, judge, try again, amend, hold down what fails.

Models are functions from DataFrame to DataFrame, so a client may batch its calls in any way (mapInPandas, a queue, a
table filled elsewhere); each round calls each of them once, for all records and fields that are still open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import evidence, gather, reports, text
from lexloom.sources import tables

RETRIES = 2


@dataclass(frozen=True)
class Agents:
    #: (record, field_pos, query_pos, query) -> (record, field_pos, query_pos, chunk_id, rank)
    search: Callable[[DataFrame], DataFrame]
    #: (record, field, passages ARRAY<STRUCT<rank, evidence_id, text>>, feedback) -> (record, field, value ARRAY<STRING>, evidence_ids, confidence, reasoning)
    draft: Callable[[DataFrame], DataFrame]
    #: (record, field, value, passages ARRAY<STRING>) of passed values -> (record, field, supported, retry_queries); None: no judge
    judge: Callable[[DataFrame], DataFrame] | None = None


def _round(todo: DataFrame, specs: DataFrame, chunks: DataFrame, agents: Agents, prefix: str) -> DataFrame:
    """todo (record, field, extra_queries, feedback) as (record, field, value, chunk_ids, sources, confidence, notes, problems, passages)."""
    asked = todo.join(F.broadcast(specs), "field")
    queries = asked.select("record", "field_pos", F.posexplode(F.concat("queries", "extra_queries")).alias("query_pos", "query"))
    best = tables.written(gather.number(gather.fuse_fields(agents.search(queries)), prefix))
    found = best.join(chunks.select("record", "chunk_id", "file_name", "page", "text"), ["record", "chunk_id"]).join(F.broadcast(specs.select("field", "field_pos")), "field_pos")
    bundles = found.groupBy("record", "field").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "text"))).alias("passages"))
    # without evidence there is nothing to ask for
    drafts = tables.written(agents.draft(todo.select("record", "field", "feedback").join(bundles, ["record", "field"])))
    proof = found.select("record", "evidence_id", "chunk_id", "file_name", "page", "text").dropDuplicates(["record", "evidence_id"])
    final = evidence.finalize_drafts(specs, drafts, proof.select("record", "evidence_id", "file_name"))
    cited = final.select("record", "field", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(proof, ["record", "evidence_id"])
    one = F.struct("pos", "chunk_id", F.struct(F.col("file_name").alias("file"), "page").alias("source"), "text")
    cited = cited.groupBy("record", "field").agg(F.array_sort(F.collect_list(one)).alias("c"))
    rows = todo.select("record", "field").join(final, ["record", "field"], "left").join(cited, ["record", "field"], "left").join(F.broadcast(specs.select("field", "kind")), "field")
    part = lambda name: F.coalesce(F.transform("c", lambda c: c[name]), F.array())
    said, whole = F.array_join(part("text"), "\n"), F.array_join("value", "; ")
    problems = F.when(F.col("value").isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(text.grounding_problems(whole, said), text.format_problems(F.col("kind"), whole))))
    return rows.select("record", "field", "value", part("chunk_id").alias("chunk_ids"), F.array_distinct(part("source")).alias("sources"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("notes", F.lit(evidence.NOT_FOUND)).alias("notes"), problems.alias("problems"), part("text").alias("passages"))


def _validate(rows: DataFrame, agents: Agents) -> DataFrame:
    """rows with status and retry_queries; the judge sees only what passed."""
    checked = tables.written(rows.withColumn("status", evidence.status(F.col("value"), F.size("chunk_ids"), F.col("problems"))))
    if agents.judge is None:
        return checked.withColumn("retry_queries", F.array().cast("array<string>"))
    passed = checked.where("status = 'passed'").select("record", "field", "value", F.transform("passages", lambda p: F.substring(p, 1, reports.FULL_CHARS)).alias("passages"))
    return tables.written(evidence.apply_judge(checked, agents.judge(passed).select("record", "field", "supported", "retry_queries")))


def run(records: DataFrame, specs: DataFrame, chunks: DataFrame, agents: Agents, retries: int = RETRIES) -> DataFrame:
    """(record, field, value, chunk_ids, sources, confidence, notes, status, tries) of every record and spec.

    specs: field, field_pos, is_list, kind, queries; a registry of a few rows, broadcast. chunks: record, chunk_id,
    file_name, page, text. A failed value is tried again up to ``retries`` times with its problems as feedback; a try
    whose value is rejected doesn't replace an earlier value. What fails to the end keeps a low confidence and a note.
    """
    none = F.array().cast("array<string>")
    todo = records.select("record").distinct().join(F.broadcast(specs.select("field")), F.lit(True)).select("record", "field", none.alias("extra_queries"), F.lit("").alias("feedback"))
    done = None
    for n in range(retries + 1):
        todo = tables.written(todo)
        if n and todo.isEmpty():
            break
        new = _validate(_round(todo, specs, chunks, agents, f"R{n}E" if n else "E"), agents).withColumn("tries", F.lit(n))
        if done is not None:
            old = done.join(todo.select("record", "field"), ["record", "field"], "left_semi").where("value IS NOT NULL").withColumn("tries", F.lit(n))
            rejected = new.where(F.col("value").isNull() & F.startswith("notes", F.lit("Rejected"))).select("record", "field").join(old.select("record", "field"), ["record", "field"], "left_semi")
            kept = done.join(todo.select("record", "field"), ["record", "field"], "left_anti")
            new = kept.unionByName(new.join(rejected, ["record", "field"], "left_anti")).unionByName(old.join(rejected, ["record", "field"], "left_semi"))
        done = tables.written(new)
        todo = done.where((F.col("status") == "failed") & (F.col("tries") == n)).select("record", "field", F.col("retry_queries").alias("extra_queries"), F.array_join("problems", "; ").alias("feedback"))
    failed = F.col("status") == "failed"
    return done.select("record", "field", "value", "chunk_ids", "sources", F.when(failed, F.least("confidence", F.lit(evidence.FAILED_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"), F.when(failed, F.concat_ws(" ", "notes", F.concat(F.lit(f"[{reports.FAILED_NOTE}: "), F.array_join("problems", "; "), F.lit("]")))).otherwise(F.col("notes")).alias("notes"), "status", "tries")
