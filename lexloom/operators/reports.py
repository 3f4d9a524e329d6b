"""Records, comparison tables, traces and their files: what is shown or kept of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators import search
from lexloom.operators.evidence import NOT_FOUND

NOT_STATED = "not stated"
CELL_CHARS = 160
FULL_CHARS = 2500
FAILED_NOTE = "Validation failed"
TOKEN_KINDS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
RECORD_SCHEMA = "record string, fields array<struct<field: string, value: array<string>, sources: array<struct<file: string, page: int>>, confidence: double, notes: string>>"


def plain_value(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(value, "; "), r"\s+", " "))


def cell(value: Column, sources: Column, notes: Column) -> Column:
    """A value in one short line with its first citation, and a sign if it failed validation."""
    flat = plain_value(value)
    short = F.when(F.length(flat) > CELL_CHARS, F.concat(F.substring(flat, 1, CELL_CHARS - 1), F.lit("…"))).otherwise(flat)
    first = F.get(sources, F.lit(0))
    cited = F.concat(short, F.when(first.isNotNull(), F.concat(F.lit(" ("), search.citation(first["file"], first["page"]), F.lit(")"))).otherwise(""))
    return F.when(value.isNull(), NOT_STATED).when(F.contains(F.coalesce(notes, F.lit("")), F.lit(FAILED_NOTE)), F.concat(F.lit("⚠ "), cited)).otherwise(cited)


def full_value(value: Column) -> Column:
    """A value as a model's input for comparisons has it."""
    return F.when(value.isNull(), NOT_STATED).otherwise(F.substring(plain_value(value), 1, FULL_CHARS))


def build_records(records: DataFrame, registry: DataFrame, results: DataFrame) -> DataFrame:
    """(record, field_pos, field, value, sources, confidence, notes): every registry field of every record.

    registry: field, field_pos, a few rows, broadcast. results: record, field, value, sources, confidence, notes.
    """
    every = records.select("record").distinct().join(F.broadcast(registry.select("field", "field_pos")), F.lit(True))
    return every.join(results.select("record", "field", "value", "sources", "confidence", "notes"), ["record", "field"], "left").select(
        "record",
        "field_pos",
        "field",
        "value",
        "sources",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("notes", F.lit(NOT_FOUND)).alias("notes"),
    )


def compare(built: DataFrame, records: list[str]) -> DataFrame:
    """(field_pos, field, a column each of ``records``): cells side by side, with 'not stated' where there is none."""
    some = built.where(F.col("record").isin(records)).withColumn("cell", cell(F.col("value"), F.col("sources"), F.col("notes")))
    wide = some.groupBy("field_pos", "field").pivot("record", records).agg(F.first("cell"))
    return wide.select("field_pos", "field", *[F.coalesce(F.col(f"`{r}`"), F.lit(NOT_STATED)).alias(r) for r in records])


def markdown(table: DataFrame, order: str) -> DataFrame:
    """(value): the lines of a Markdown table; columns other than ``order``."""
    shown = [c for c in table.columns if c != order]
    row = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    body = table.select(F.lit(1).alias("_part"), F.col(order).cast("long").alias("_at"), row([F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in shown]).alias("value"))
    head = table.sparkSession.createDataFrame([(0, 0, "| " + " | ".join(shown) + " |"), (0, 1, "|" + "---|" * len(shown))], "_part int, _at long, value string")
    return head.unionByName(body).orderBy("_part", "_at").select("value")


def summary_sources(built: DataFrame, fields: list[str]) -> DataFrame:
    """(record, sources): the first source of each of ``fields``, in their order, each once."""
    at = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    firsts = built.where(F.col("field").isin(fields) & (F.size("sources") > 0)).groupBy("record").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.get("sources", F.lit(0)).alias("source")))).alias("x"))
    return firsts.select("record", F.array_distinct(F.transform("x", lambda x: x["source"])).alias("sources"))


def write_records(built: DataFrame, path: str) -> None:
    """A JSON object a line for each record, its fields in registry order."""
    one = F.struct("field_pos", "field", "value", "sources", "confidence", "notes")
    rows = built.groupBy("record").agg(F.array_sort(F.collect_list(one)).alias("fields"))
    rows.select("record", F.transform("fields", lambda f: f.dropFields("field_pos")).alias("fields")).write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files; what can't be parsed or isn't a record is skipped."""
    return spark.read.schema(RECORD_SCHEMA).option("mode", "PERMISSIVE").json(path).where("record IS NOT NULL AND fields IS NOT NULL")


def catalog(files: DataFrame, built: DataFrame, title: str, company: str) -> DataFrame:
    """(record, name): 'title - company' where results have them, else the record's id."""
    known = built.where(F.col("field").isin(title, company)).groupBy("record").agg(F.max(F.when(F.col("field") == title, plain_value(F.col("value")))).alias("t"), F.max(F.when(F.col("field") == company, plain_value(F.col("value")))).alias("c"))
    return files.select(F.col("collection").alias("record")).distinct().join(known, "record", "left").select("record", F.coalesce(F.nullif(F.concat_ws(" - ", "t", "c"), F.lit("")), "record").alias("name"))


def trace_by_node(events: DataFrame) -> DataFrame:
    """events: run_id, node, latency_ms, cost, error, calls ARRAY<STRUCT<model, four kinds of tokens>>."""
    return events.groupBy("run_id", "node").agg(F.sum("latency_ms").alias("latency_ms"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"))


def trace_by_model(events: DataFrame) -> DataFrame:
    calls = events.select("run_id", F.explode("calls").alias("c")).select("run_id", "c.*")
    return calls.groupBy("run_id", F.coalesce("model", F.lit("?")).alias("model")).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in TOKEN_KINDS])


def trace_totals(events: DataFrame) -> DataFrame:
    """One row a run: steps, calls, tokens, cost and errors in the order of their text."""
    tokens = lambda kind: F.aggregate(F.coalesce("calls", F.array()), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[kind], F.lit(0)))
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum(F.greatest(F.size(F.coalesce("calls", F.array())), F.lit(0))).alias("llm_calls"),
        *[F.sum(tokens(k)).alias(k) for k in TOKEN_KINDS[:2]],
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"),
        F.sort_array(F.collect_list("error")).alias("errors"),
    )


def write_trace(events: DataFrame, path: str) -> None:
    """Events as JSON lines by run, and one summary line a run."""
    events.write.mode("append").partitionBy("run_id").json(f"{path}/trace")
    trace_totals(events).write.mode("append").json(f"{path}/summary")


def run_history(spark: SparkSession, path: str, last: int = 15) -> DataFrame:
    """The ``last`` summaries by the time of their files."""
    schema = "run_id string, steps long, llm_calls long, input_tokens long, output_tokens long, cost double, errors array<string>"
    rows = spark.read.schema(schema).json(f"{path}/summary").select("*", F.col("_metadata.file_modification_time").alias("written"))
    return rows.where("run_id IS NOT NULL").orderBy(F.desc("written"), "run_id").limit(last)


def history_totals(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"), F.count_if(F.col("llm_calls") == 0).alias("without_calls"))


def answer_log(answers: DataFrame, path: str) -> None:
    """Appends answers (question, text, cited ARRAY<STRING>, asked) to a log of Markdown lines."""
    lines = F.concat(F.lit("## "), F.date_format("asked", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("question"), F.lit("\n\n"), F.col("text"), F.when(F.size("cited") > 0, F.concat(F.lit("\n\nSources: "), F.array_join("cited", "; "))).otherwise(""), F.lit("\n"))
    answers.select(lines.alias("value")).write.mode("append").text(path)


def score(built: DataFrame, gold: DataFrame) -> DataFrame:
    """(record, category, n, mean): outcomes of fields against gold values, with a line for all records (record null).

    gold: record, field, expected ARRAY<STRING>, null where the documents don't state it.
    """
    both = gold.join(built.select("record", "field", "value"), ["record", "field"], "left")
    share = F.size(F.array_intersect(F.transform("expected", F.lower), F.transform("value", F.lower))) / F.greatest(F.lit(1), F.size("expected"))
    points = F.when(F.col("expected").isNull(), F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).when(F.col("value").isNull(), 0.0).otherwise(share)
    kind = F.when(F.col("expected").isNull(), F.when(F.col("value").isNull(), "correct absent").otherwise("false positive")).when(F.col("value").isNull(), "missed").when(share == 1, "correct").when(share > 0, "partial").otherwise("wrong")
    return both.select("record", kind.alias("category"), points.alias("points")).rollup("category", "record").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("points"), 4).alias("mean")).where("category IS NOT NULL")


def last_rows(rows: DataFrame, group: str, order: str, last: int) -> DataFrame:
    """The last rows of each group by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_r") <= last).drop("_r")
