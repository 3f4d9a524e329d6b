"""Lines, boilerplate, cleaning and extraction of facts from text, as column expressions and DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_LINES = 3
BOILERPLATE_CHARS = 120
# The patterns of facts, and the words that announce a change.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"
PHONE = r"\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}"
TIME = r"(?i)(?:\b([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?\s*([ap]\.?m\.?)?|\b([0-9]{1,2})\s*([ap]\.?m\.?)(?![a-z]))"
TIME_ZONE = r"\b(?:[ECMP][SD]?T|UTC|GMT)\b|\b(?:Eastern|Central|Mountain|Pacific)\b"
MONTH_DATE = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b"
SLASH_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
DASH_DATE = r"\b(\d{1,2})-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-(\d{4})\b"
CHANGE_CUE = r"(?i)\b(?:new|revised|amended|updated|extend(?:ed|s)?|changed?|replaced?|instead)\b\s*"
PAGE_LABEL = r"(?i)^(page\s*)?\d+(\s*(of|/|\|)\s*\d+)?$"


def line_key(line: Column) -> Column:
    """Lower case, digit runs as #, white space collapsed: equal for lines that differ in a page number alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "#"), r"\s+", " "))


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def edge_lines(text: Column, n: int = EDGE_LINES) -> Column:
    """The first and last n lines that aren't blank."""
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.concat(F.slice(full, 1, n), F.slice(full, F.greatest(F.lit(1), F.size(full) - n + 1), n))


def boilerplate(pages: DataFrame, group: str, page: str, min_ratio: float = 0.5, least: int = 2) -> DataFrame:
    """(group, key): keys of edge lines on at least max(least, ceil(min_ratio * pages)) pages of the group."""
    keys = pages.select(group, page, F.explode(edge_lines(F.col("text"))).alias("line")).where(F.length(F.trim("line")) <= BOILERPLATE_CHARS)
    counts = keys.select(group, page, line_key(F.col("line")).alias("key")).groupBy(group, "key").agg(F.count_distinct(page).alias("n_pages"))
    total = pages.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    return counts.join(total, group).where((F.col("pages") >= 2) & (F.col("n_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * min_ratio)))).select(group, "key", "n_pages")


def clean_pages(pages: DataFrame, group: str, page: str, min_ratio: float = 0.5, least: int = 2) -> DataFrame:
    """pages (with headings ARRAY<STRING>) without boilerplate lines, page labels and headings of either kind, with is_empty.

    A group's boilerplate keys are few (edge lines on a share of its pages), so they come to each page as one array and the
    lines are filtered inside the row; texts are not shuffled by line.
    """
    keys = boilerplate(pages, group, page, min_ratio, least).groupBy(group).agg(F.collect_set("key").alias("_keys"))
    both = pages.join(keys, group, "left").withColumn("_keys", F.coalesce("_keys", F.array().cast("array<string>")))
    stays = lambda x: ~F.array_contains("_keys", line_key(x)) & ~F.trim(x).rlike(PAGE_LABEL)
    text = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    out = both.withColumn("text", text).withColumn("headings", F.filter("headings", stays)) if "headings" in pages.columns else both.withColumn("text", text)
    return out.drop("_keys").withColumn("is_empty", F.trim("text") == "")


def drop_lines(pages: DataFrame, group: str, page: str, keys: DataFrame) -> DataFrame:
    """(group, page, text): pages without the lines whose key is among keys (group, key), filtered inside the row."""
    own = keys.groupBy(group).agg(F.collect_set("key").alias("_keys"))
    both = pages.select(group, page, "text").join(own, group, "left")
    stays = lambda x: ~F.array_contains(F.coalesce("_keys", F.array().cast("array<string>")), line_key(x))
    return both.select(group, page, F.coalesce(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"), F.lit("")).alias("text"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def clean(text: Column, normalise: bool = True) -> Column:
    """NFKC, no-break spaces, one bullet a line, wrapped lines joined, long gaps and blank runs shortened."""
    t = nfkc(text) if normalise else text
    t = F.regexp_replace(t, " ", " ")
    t = F.regexp_replace(t, r"[ \t]+(?=[•▪●])", "\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    # a line that ends in no stop, before one that begins with a small letter and has no column gap, goes on
    t = F.regexp_replace(t, r"(?<![.:;!?\n])\n(?=\p{Ll}(?!\)|\.\s)(?:(?!\n|   ).)*(?:\n|$))", " ")
    t = F.regexp_replace(t, " {4,}", "   ")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1)


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1)


def numbers(text: Column) -> Column:
    """Digit runs without leading zeros, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))


def _parsed(text: Column, pattern: str, form: Callable[[Column], list[Column]]) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), 1), lambda x: F.coalesce(*form(x)))


def dates(text: Column) -> Column:
    """Dates in the known formats, each once; month first, day first where that is impossible; invalid ones are left out."""
    part = lambda x, p, i: F.regexp_extract(x, f"(?i){p}", i)
    named = lambda x, p, d, m: F.try_to_date(F.concat_ws(" ", part(x, p, d), F.initcap(part(x, p, m)), part(x, p, 3)), "d MMM yyyy")
    found = [
        _parsed(text, SLASH_DATE, lambda x: [F.try_to_date(x, "M/d/yyyy"), F.try_to_date(x, "d/M/yyyy")]),
        _parsed(text, MONTH_DATE, lambda x: [named(x, MONTH_DATE, 2, 1)]),
        _parsed(text, DASH_DATE, lambda x: [named(x, DASH_DATE, 1, 2)]),
    ]
    return F.array_distinct(F.filter(F.concat(*found), lambda d: d.isNotNull()))


def times(text: Column) -> Column:
    """Minutes since midnight of the times in a text: 14:05, 2:30 p.m., 2 PM; hours above 23 and minutes above 59 are none."""
    parts = [F.regexp_extract_all(text, F.lit(TIME), i) for i in (1, 2, 3, 4, 5)]
    whole = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("h", "m", "a", "k", "b"), strict=True)])

    def minute(t):
        h, half = F.coalesce(F.nullif(t["h"], F.lit("")), t["k"]).try_cast("int"), F.lower(F.concat(t["a"], t["b"]))
        m = F.coalesce(F.nullif(t["m"], F.lit("")).try_cast("int"), F.lit(0))
        h = F.when(half.startswith("p"), h % 12 + 12).when(half.startswith("a"), h % 12).otherwise(h)
        return F.when((h <= 23) & (m <= 59), h * 60 + m)

    return F.array_distinct(F.filter(F.transform(whole, minute), lambda x: x.isNotNull()))


def grounding_problems(value: Column, evidence: Column) -> Column:
    """What of a value its cited text doesn't bear out: e-mails, dates, times, then the numbers left."""
    plain = value
    for pattern in (EMAIL, SLASH_DATE, MONTH_DATE, DASH_DATE, TIME):
        plain = F.regexp_replace(plain, pattern if pattern.startswith("(?i)") else f"(?i){pattern}", " ")
    mail = F.array_distinct(F.filter(F.transform(emails(value), F.lower), lambda m: ~F.contains(F.lower(evidence), m)))
    day = F.transform(F.array_except(dates(value), dates(evidence)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    clock = F.transform(F.array_except(times(value), times(evidence)), lambda t: F.format_string("%02d:%02d", F.floor(t / 60), t % 60))
    number = F.array_except(numbers(plain), numbers(evidence))
    tag = lambda name, x: F.transform(x, lambda v: F.concat(F.lit(f"{name} "), v))
    return F.concat(tag("email", mail), tag("date", day), tag("time", clock), tag("number", number))


def format_problems(kind: Column, value: Column, is_list: Column | None = None) -> Column:
    """Problems of a value in its declared format. is_list: whether the value is one (a list must be)."""
    day, clock = F.size(dates(value)) > 0, F.size(times(value)) > 0
    said = lambda fails, what: F.when(fails, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    moment = F.concat(said(~day, "no date"), said(~clock, "no time"))
    contact = said((F.size(emails(value)) == 0) & (F.size(phones(value)) == 0), "no e-mail or phone")
    listed = said(~(is_list if is_list is not None else F.lit(True)), "no list")
    return F.when(kind == "datetime", moment).when(kind == "date", said(~day, "no date")).when(kind == "contact", contact).when(kind == "list", listed).otherwise(F.array().cast("array<string>"))


def format_warnings(kind: Column, value: Column) -> Column:
    """A time of day without a time zone."""
    return F.when((kind == "datetime") & (F.size(times(value)) > 0) & ~value.rlike(TIME_ZONE), F.array(F.lit("no time zone"))).otherwise(F.array().cast("array<string>"))


def guard_tokens(question: Column) -> Column:
    """Sorted distinct lower-case tokens that hold a digit: two questions with different ones are never the same."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9#-]+)"), 1), lambda t: t.rlike("[0-9]"))))


def change_sentences(text: Column, limit: int = 3) -> Column:
    """Sentences that announce a change, without the announcing words: queries for the second hop."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s.rlike(CHANGE_CUE))
    return F.slice(F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, CHANGE_CUE, ""))), lambda s: F.length(s) > 15), 1, limit)


def fold_dashes(text: Column) -> Column:
    """Dashes of all widths and the minus sign as hyphens."""
    return F.translate(text, "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-------")
