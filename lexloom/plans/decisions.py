"""Whole runs over records: amendments against base texts, comparisons, and decisions to bid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import evidence, gather, reports, text

NOT_ASSESSED = "Not assessed."


def reconciliation_evidence(specs: DataFrame, hits: DataFrame, chunks: DataFrame, keep: int = 5) -> DataFrame:
    """(record, field_pos, chunk_id, rank, evidence_id, addendum_number): for the fields that amendments may change, evidence from
    amendments (A1, ...) and from base texts (B1, ...); records without evidence from an amendment are left out.

    specs: field_pos, sensitive. hits: record, field_pos, query_pos, chunk_id, rank. chunks: record, chunk_id, doc_type,
    addendum_number.
    """
    wanted = hits.join(F.broadcast(specs.where("sensitive").select("field_pos")), "field_pos").join(chunks, ["record", "chunk_id"])
    parts = []
    for prefix, amended in (("A", F.col("doc_type") == "addendum"), ("B", F.col("doc_type") != "addendum")):
        parts.append(gather.number(gather.fuse_fields(wanted.where(amended).select("record", "field_pos", "query_pos", "chunk_id", "rank"), keep), prefix))
    found = parts[0].unionByName(parts[1]).join(parts[0].select("record").distinct(), "record", "left_semi")
    return found.join(chunks.select("record", "chunk_id", "addendum_number"), ["record", "chunk_id"]).select("record", "field_pos", "chunk_id", "rank", "evidence_id", "addendum_number")


def reconcile(results: DataFrame, specs: DataFrame, hits: DataFrame, chunks: DataFrame, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, changes) after a model (evidence -> record, field, changed, addendum_number, new_value, new_evidence_ids) has seen
    the evidence of both sides."""
    proof = reconciliation_evidence(specs, hits, chunks).join(F.broadcast(specs.select("field", "field_pos")), "field_pos")
    return evidence.apply_amendments(results, model(proof), proof.select("record", "evidence_id", "addendum_number").distinct())


def go_no_go(records: DataFrame, built: DataFrame, criteria: DataFrame, as_of: Column, assess: Callable[[DataFrame], DataFrame] | None = None, due: str = "Due Date", least_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """((record, pos, id, must_have, status, reason), (record, decision)).

    The deadline is checked by date alone. assess: records with a column of each criterion to ask (record, id) -> record, id,
    status, reason; what it says of the deadline or of unknown criteria plays no part, what it leaves out is unknown.
    """
    dates = built.where(F.col("field") == due).select("record", text.dates(F.array_join("value", "; ")).alias("d"))
    every = records.select("record").distinct()
    deadline = every.join(dates, "record", "left").select("record", F.lit("deadline").alias("id"), evidence.deadline_status(F.coalesce("d", F.array().cast("array<date>")), as_of, least_days).alias("status"), F.lit("by date").alias("reason"))
    asked = every.join(F.broadcast(criteria.where("id <> 'deadline'").select("id")), F.lit(True))
    told = deadline if assess is None else deadline.unionByName(assess(asked).join(F.broadcast(criteria.where("id <> 'deadline'").select("id")), "id", "left_semi").select("record", "id", "status", "reason").dropDuplicates(["record", "id"]))
    rows = every.join(F.broadcast(criteria), F.lit(True)).join(told, ["record", "id"], "left")
    rows = rows.select("record", "pos", "id", "must_have", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("reason", F.lit(NOT_ASSESSED)).alias("reason"))
    return rows, evidence.decide(criteria, told, records)


def decision_lines(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(record, value): each record's decision and criteria as Markdown."""
    line = F.concat(F.lit("| "), "id", F.when(F.col("must_have"), " (must)").otherwise(""), F.lit(" | "), "status", F.lit(" | "), F.replace("reason", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    body = rows.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("b"))
    head = F.concat(F.lit("# "), F.col("record").cast("string"), F.lit(": "), "decision", F.lit("\n\n| Criterion | Status | Reason |\n|---|---|---|\n"))
    return decisions.join(body, "record").select("record", F.concat(head, F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("value"))


def compare(built: DataFrame, records: list[str] | None = None, analyse: Callable[[DataFrame], str] | None = None) -> tuple[DataFrame, str]:
    """(the table of records side by side, what a model says of their full values). Without names all records are compared; fewer
    than two are an error."""
    names = records or sorted(r[0] for r in built.select("record").distinct().collect())
    if len(names) < 2:
        raise ValueError("a comparison needs two records at least")
    missing = set(names) - {r[0] for r in built.where(F.col("record").isin(names)).select("record").distinct().collect()}
    if missing:
        raise KeyError(f"no record of {sorted(missing)}")
    whole = built.where(F.col("record").isin(names)).select("record", "field_pos", "field", reports.full_value(F.col("value")).alias("value"))
    return reports.compare(built, names), analyse(whole) if analyse else ""
