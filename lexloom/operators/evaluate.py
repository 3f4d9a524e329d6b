"""Evaluation: hits of searches, field scores against gold values, stability over runs and gates."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators import search, text

# Similarities from which an item or a text counts as found, and the gate.
LIST_SIMILARITY, TEXT_SIMILARITY = 85, 90
GATE = {"r5": 0.90, "mrr": 0.75}


def is_hit(file_name: Column, page: Column, passage: Column, gold: Column) -> Column:
    """Whether some of gold (ARRAY<STRUCT<file, page, contains>>) names this file (in part), page and text (in part)."""
    within = lambda whole, part: F.contains(F.lower(whole), F.lower(part))
    return F.exists(gold, lambda g: within(file_name, g["file"]) & (page == g["page"]) & within(passage, g["contains"]))


def retrieval(questions: DataFrame, results: DataFrame, top: int = 10) -> DataFrame:
    """(id, first): the first hit of each question, null without one. questions: id, gold. results: id, rank, file_name, page,
    text. The gold of a question is one array, so it meets its results in an equality join."""
    met = results.where(F.col("rank") <= top).join(questions.select("id", "gold"), "id").where(is_hit(F.col("file_name"), F.col("page"), F.col("text"), F.col("gold")))
    return questions.select("id").distinct().join(met.groupBy("id").agg(F.min("rank").alias("first")), "id", "left")


def passes(metrics: DataFrame, gate: dict[str, float] = GATE) -> DataFrame:
    """One row: whether the metrics of ``search.metrics`` reach the gate."""
    ok = F.lit(True)
    for name, least in gate.items():
        ok = ok & (F.col(name) >= least)
    return metrics.select(ok.alias("passed"))


def configurations(questions: DataFrame, configs: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A row of metrics for each named search (questions -> results), all in one plan."""
    out = None
    for name, run in configs.items():
        row = search.metrics(retrieval(questions, run(questions))).withColumn("config", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def normalised(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text.fold_dashes(value)), r"\s+", " "))


def has_alternative(wanted: Column, value: Column) -> Column:
    """Whether one of the alternatives of wanted (parted by bars) is in a normalised value."""
    return F.exists(F.split(wanted, r"\|"), lambda a: F.contains(value, normalised(a)))


def partial_ratio(short: str, long: str) -> float:
    """0 to 100: the best similarity of the shorter text with a window of the longer one of its length."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 100.0 if not long else 0.0
    match = difflib.SequenceMatcher(None, short, long, autojunk=False)
    starts = {max(0, min(b.b - b.a, len(long) - len(short))) for b in match.get_matching_blocks()}
    return max(100 * difflib.SequenceMatcher(None, short, long[s : s + len(short)], autojunk=False).ratio() for s in starts)


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best similarity of the common words, and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(own))])) for own in (x - y, y - x))
    ratio = lambda p, q: 100 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio()
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


@F.pandas_udf(T.DoubleType())
def text_similarity(wanted: pd.Series, value: pd.Series) -> pd.Series:
    """1 from TEXT_SIMILARITY on, else the similarity of two normalised texts."""
    ratios = [token_set_ratio(a or "", b or "") for a, b in zip(wanted, value, strict=True)]
    return pd.Series([1.0 if r >= TEXT_SIMILARITY else r / 100 for r in ratios])


@F.pandas_udf(T.DoubleType())
def list_recall(wanted: pd.Series, values: pd.Series) -> pd.Series:
    """The share of wanted items (with alternatives, all normalised) that some item of a value is like."""
    found = lambda w, v: any(partial_ratio(a, x) >= LIST_SIMILARITY for a in w.split("|") for x in v)
    return pd.Series([sum(found(w, v) for w in ws) / max(1, len(ws)) for ws, v in zip(wanted, values, strict=True)])


def score_fields(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(record, field, category, score, cited): each gold entry against the result of its field.

    gold: record, field, kind (keywords, datetime, list, text, or null: the documents don't state it), expected ARRAY<STRING>,
    accept_null, source (a part of the file's name, with alternatives; null: not checked). results: record, field, value
    ARRAY<STRING>, files ARRAY<STRING>.
    """
    both = gold.join(results.select("record", "field", "value", "files"), ["record", "field"], "left")
    said, first = normalised(F.array_join("value", "; ")), F.get("expected", F.lit(0))
    facts = lambda x: F.concat(F.transform(text.dates(x), lambda d: d.cast("string")), F.transform(text.times(x), lambda t: t.cast("string")))
    share = lambda got, wanted: F.size(got) / F.greatest(F.lit(1), F.size(wanted))
    plain = F.array_join("value", "; ")
    dated = share(F.array_intersect(facts(first), facts(plain)), facts(first))
    words = share(F.filter("expected", lambda k: has_alternative(k, said)), F.col("expected"))
    none = F.array().cast("array<string>")
    listed = list_recall(F.coalesce(F.transform("expected", normalised), none), F.coalesce(F.transform("value", normalised), none))
    alike = text_similarity(normalised(first), said)
    kind, absent = F.col("kind"), F.col("value").isNull()
    score = F.when(kind.isNull(), absent.cast("double")).when(absent, F.coalesce("accept_null", F.lit(False)).cast("double"))
    score = score.when(kind == "keywords", words).when(kind == "datetime", dated).when(kind == "list", listed).otherwise(alike)
    scored = both.withColumn("score", score)
    category = F.when(kind.isNull() & ~absent, "false_positive").when(~kind.isNull() & absent & (F.col("score") < 1), "missed").when(F.col("score") >= 1, "correct").when(F.col("score") > 0, "partial").otherwise("wrong")
    cited = F.when(F.col("source").isNotNull() & ~absent, F.exists(F.coalesce("files", none), lambda f: has_alternative(F.col("source"), normalised(f))))
    return scored.select("record", "field", category.alias("category"), "score", cited.alias("cited"))


def report(scores: DataFrame) -> DataFrame:
    """(record, fields, correct, partial, wrong, missed, false_positive, score): a row a record and, with record null, of all."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in ("correct", "partial", "wrong", "missed", "false_positive")]
    return scores.rollup("record").agg(F.count(F.lit(1)).alias("fields"), *counts, F.round(F.avg("score"), 6).alias("score"))


def stability(scores: DataFrame) -> DataFrame:
    """(record, field, runs, correct, unstable) of the scores of several runs."""
    good = F.col("category") == "correct"
    return scores.groupBy("record", "field").agg(F.count(F.lit(1)).alias("runs"), F.count_if(good).alias("correct"), (~F.bool_and(good)).alias("unstable"))
