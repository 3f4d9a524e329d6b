"""Drafts to results: value clean-up, citation guardrails, identifier completion, amendments, statuses and decisions.

A result is a row of (record, field, value ARRAY<STRING>, sources, confidence, notes); a scalar is an array of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import text

NOT_FOUND = "Not found in documents"
#: Answers that say that there is none.
EMPTY_VALUES = ["", "null", "none found", "n/a", "not found", "unknown", "not specified"]
AMENDED_CONFIDENCE = 0.9
FAILED_CONFIDENCE = 0.4
SNIPPET_CHARS = 200


def normalize_value(value: Column, is_list: Column) -> Column:
    """Items trimmed, each once, without placeholders; a scalar's items in one, split by semicolons; nothing is null."""
    items = F.array_distinct(F.filter(F.transform(value, lambda v: F.trim(v)), lambda v: v.isNotNull() & ~F.lower(v).isin(EMPTY_VALUES)))
    return F.when(F.size(items) > 0, F.when(is_list, items).otherwise(F.array(F.array_join(items, "; "))))


def finalize_drafts(specs: DataFrame, drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record, field, value, evidence_ids, files, confidence, notes): one row for each record and spec.

    specs: field, is_list. drafts: record, field, value, evidence_ids, confidence, reasoning. evidence: record,
    evidence_id, file_name. Ids that aren't evidence of the record are dropped; a value left without any is rejected;
    a field without a draft is null. Specs are a registry of a few rows, so they are broadcast to the records.
    """
    wanted = drafts.select("record").distinct().join(F.broadcast(specs.select("field", "is_list")), F.lit(True))
    cited = drafts.select("record", "field", F.posexplode(F.array_distinct("evidence_ids")).alias("pos", "evidence_id"))
    real = cited.join(evidence.select("record", "evidence_id", "file_name"), ["record", "evidence_id"]).groupBy("record", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "file_name"))).alias("real"))
    rows = wanted.join(drafts.withColumn("drafted", F.lit(True)), ["record", "field"], "left").join(real, ["record", "field"], "left")
    proposed = normalize_value(F.col("value"), F.col("is_list"))
    has = F.coalesce(F.size("real") > 0, F.lit(False))
    return rows.withColumn("proposed", proposed).select(
        "record",
        "field",
        F.when(has, F.col("proposed")).alias("value"),
        F.when(has & F.col("proposed").isNotNull(), F.transform("real", lambda r: r["evidence_id"])).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(has & F.col("proposed").isNotNull(), F.array_distinct(F.transform("real", lambda r: r["file_name"]))).otherwise(F.array().cast("array<string>")).alias("files"),
        F.when(F.col("drafted").isNull() | (F.col("proposed").isNotNull() & ~has), F.lit(0.0)).otherwise(F.round("confidence", 2)).alias("confidence"),
        F.when(F.col("drafted").isNull(), f"{NOT_FOUND} (no draft)")
        .when(F.col("proposed").isNotNull() & ~has, "Rejected: value had no valid citation")
        .when(F.col("proposed").isNull(), F.trim(F.concat(F.lit(f"{NOT_FOUND}. "), F.coalesce("reasoning", F.lit("")))))
        .otherwise(F.col("reasoning"))
        .alias("notes"),
    )


def complete_ids(value: Column, texts: Column, patterns: list[str]) -> Column:
    """A list with the matches of patterns in cited texts that it lacks, in the order of the texts."""
    def found(pattern: str) -> Column:
        return F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)))

    return F.array_distinct(F.concat(value, *map(found, patterns)))


def apply_amendments(results: DataFrame, findings: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, changes): values replaced by an addendum's where that is cited.

    findings: record, field, changed, addendum_number, new_value, new_evidence_ids. evidence: record, evidence_id,
    addendum_number (null: not of an addendum). A change without evidence of an addendum or without a value is not made.
    """
    cited = findings.where("changed").select("record", "field", F.explode(F.array_distinct("new_evidence_ids")).alias("evidence_id"))
    proof = cited.join(evidence.where("addendum_number IS NOT NULL").withColumnRenamed("addendum_number", "_n"), ["record", "evidence_id"])
    proof = proof.groupBy("record", "field").agg(F.max("_n").alias("_latest"))
    good = findings.where("changed AND size(new_value) > 0").join(proof, ["record", "field"])
    good = good.select("record", "field", "new_value", F.coalesce("addendum_number", "_latest").alias("addendum_number"))
    both = results.join(good, ["record", "field"], "left")
    hit = F.col("new_value").isNotNull()
    after = both.select(*[c for c in results.columns if c not in ("value", "confidence")], F.coalesce("new_value", "value").alias("value"), F.when(hit, F.greatest("confidence", F.lit(AMENDED_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"))
    changes = both.where(hit).select("record", "field", F.col("value").alias("old_value"), "new_value", "addendum_number")
    return after.select(*results.columns), changes


def status(value: Column, n_sources: Column, problems: Column) -> Column:
    """not_found without a value, failed without a source or with problems, else passed."""
    return F.when(value.isNull() | (F.size(value) == 0), "not_found").when((F.coalesce(n_sources, F.lit(0)) == 0) | (F.size(problems) > 0), "failed").otherwise("passed")


def apply_judge(validations: DataFrame, verdicts: DataFrame, most: int = 3) -> DataFrame:
    """validations (record, field, status, ...) in which an unsupported passed value fails, with up to ``most`` queries
    for the next try. verdicts: record, field, supported, retry_queries; a field without a verdict stays as it is."""
    both = validations.join(verdicts, ["record", "field"], "left")
    flips = (F.col("status") == "passed") & ~F.coalesce("supported", F.lit(True))
    kept = [F.when(flips, "failed").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in validations.columns]
    return both.select(*kept, F.when(flips, F.slice("retry_queries", 1, most)).otherwise(F.array().cast("array<string>")).alias("retry_queries"))


def retryable(validations: DataFrame, tries: DataFrame, most: int = 2) -> DataFrame:
    """(record, field) of failed values that have been tried again fewer than ``most`` times. tries: record, field, n."""
    return validations.where("status = 'failed'").join(tries, ["record", "field"], "left").where(F.coalesce("n", F.lit(0)) < most).select("record", "field")


def downgrade(results: DataFrame, validations: DataFrame) -> DataFrame:
    """results in which values that still fail are held at a low confidence."""
    both = results.join(validations.select("record", "field", "status"), ["record", "field"], "left")
    capped = F.when(F.col("status") == "failed", F.least("confidence", F.lit(FAILED_CONFIDENCE))).otherwise(F.col("confidence"))
    return both.withColumn("confidence", capped).select(*results.columns)


def number_evidence(hits: DataFrame, question: str) -> DataFrame:
    """hits with n, from 1 in each question: by collection, then by falling score, then by chunk."""
    w = Window.partitionBy(question).orderBy("collection", F.desc("score"), "chunk_id")
    return hits.withColumn("n", F.row_number().over(w))


def check_citations(answer: Column, found: Column, n_passages: Column) -> Column:
    """(text, cited, found): marks of passages that don't exist go; without any left the answer is not found."""
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), 1))
    valid = lambda m: F.coalesce(m.try_cast("int").between(1, n_passages), F.lit(False))
    text = F.aggregate(F.filter(marks, lambda m: ~valid(m)), answer, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    used = F.array_sort(F.array_distinct(F.transform(F.filter(marks, valid), lambda m: m.cast("int"))))
    ok = F.coalesce(found, F.lit(False)) & (F.size(used) > 0)
    return F.struct(F.when(ok, F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(NOT_FOUND).alias("text"), F.when(ok, used).otherwise(F.array().cast("array<int>")).alias("cited"), ok.alias("found"))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def deadline_status(dates: Column, as_of: Column, least_days: int = 14) -> Column:
    """By the last of dates: fail if it is past or fewer than least_days off, unknown without one, else pass."""
    last = F.array_max(dates)
    return F.when(last.isNull(), "unknown").when(F.datediff(last, as_of) < least_days, "fail").otherwise("pass")


def decide(criteria: DataFrame, assessments: DataFrame, records: DataFrame) -> DataFrame:
    """(record, decision): NO-GO if a must-have fails, REVIEW if one is unknown or not assessed, else GO.

    criteria: id, must_have (a few rows, broadcast). assessments: record, id, status; unknown ids play no part.
    """
    asked = records.select("record").distinct().join(F.broadcast(criteria.select("id", "must_have")), F.lit(True))
    met = asked.join(assessments.select("record", "id", "status"), ["record", "id"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    fails, unknown = (F.bool_or(F.col("must_have") & (F.col("status") == s)) for s in ("fail", "unknown"))
    return met.groupBy("record").agg(F.when(fails, "NO-GO").when(unknown, "REVIEW").otherwise("GO").alias("decision"))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost (null where the model has no price). prices: model, input, output, cache_read, cache_write per
    million tokens; cached tokens cost 0.1 and 1.25 times the input where no price is given. A few rows, broadcast."""
    p = prices.select("model", F.col("input").alias("_i"), F.col("output").alias("_o"), F.coalesce("cache_read", F.col("input") * 0.1).alias("_r"), F.coalesce("cache_write", F.col("input") * 1.25).alias("_w"))
    total = F.col("input_tokens") * F.col("_i") + F.col("output_tokens") * F.col("_o") + F.col("cache_read_tokens") * F.col("_r") + F.col("cache_write_tokens") * F.col("_w")
    return calls.join(F.broadcast(p), "model", "left").withColumn("cost", F.round(total / 1_000_000, 6)).drop("_i", "_o", "_r", "_w")


def cross_field_problems(results: DataFrame, earlier: str = "Pre Bid Meeting", later: str = "Due Date") -> DataFrame:
    """(record, field, problem): the field ``earlier`` of records whose least date is past the last one of ``later``."""
    dated = results.where(F.col("field").isin(earlier, later) & F.col("value").isNotNull()).withColumn("d", text.dates(F.array_join("value", "; ")))
    both = dated.groupBy("record").agg(F.min(F.when(F.col("field") == earlier, F.array_min("d"))).alias("a"), F.max(F.when(F.col("field") == later, F.array_max("d"))).alias("b"))
    said = F.format_string("%s date %s is after %s date %s", F.lit(earlier), F.col("a").cast("string"), F.lit(later), F.col("b").cast("string"))
    return both.where("a > b").select("record", F.lit(earlier).alias("field"), said.alias("problem"))


def status_counts(validations: DataFrame, *by: str) -> DataFrame:
    """Validations by status, for each value of ``by`` (or in all)."""
    return validations.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "not_found")])


def field_block(specs: DataFrame) -> DataFrame:
    """(block): the fields of a group as a prompt states them. specs: field, field_pos, kind, description."""
    line = F.concat(F.lit("- "), "field", F.lit(" ("), "kind", F.lit("): "), F.coalesce("description", F.lit("")))
    return specs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def evidence_block(passages: Column) -> Column:
    """Passages (ARRAY<STRUCT<rank, evidence_id, text>>) as a prompt states them, by rank, each once."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(passages), lambda p: F.concat(F.lit("["), p["evidence_id"], F.lit("] "), p["text"]))), "\n\n")
