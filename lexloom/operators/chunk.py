"""Sections and chunks: headings, greedy packing, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: RFC 4122 namespace of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def count_tokens(text: Column) -> Column:
    """Words and marks; a stand-in for a model's tokenizer, which needs a vocabulary file."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+|[^\sA-Za-z0-9])"), 1))


# The shapes of headings and of sentence ends.
MARKDOWN = r"^#{1,3}\s+(.+)$"
SECTION_WORD = r"(?i)^(section|article|part|attachment|exhibit)\s+([0-9]+|[IVX]+)\b.{0,80}$"
NUMBERED = r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Z][^.]{2,70}$"
LEADING_CAPS = r"^([A-Z][A-Z0-9 ,&()/'\-]{6,80}?)\s+[A-Z][a-z]"
COLUMN_BREAK = "   "


def heading(line: Column, known: Column | None = None) -> Column:
    """The heading that a line is, or null: a known one, markdown, section words, numbered without a colon, shouted, or capitals
    before an ordinary sentence. Lines with a column break are rows of a table."""
    t = F.trim(line)
    words = F.size(F.split(t, r"\s+"))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    shouted = (t == F.upper(t)) & (t != F.lower(t)) & words.between(2, 10) & (F.length(t) <= 80) & ~t.rlike("[.,;]$") & (letters >= 4)
    capitals = F.trim(F.regexp_extract(t, LEADING_CAPS, 1))
    rules = F.when(t.rlike(MARKDOWN), F.trim(F.regexp_extract(t, MARKDOWN, 1))).when(F.contains(t, F.lit(COLUMN_BREAK)), F.lit(None).cast("string"))
    rules = rules.when(t.rlike(SECTION_WORD) & ~t.endswith("."), t).when(t.rlike(NUMBERED) & ~F.contains(t, F.lit(":")), t).when(shouted, t)
    rules = rules.when((F.size(F.split(capitals, r"\s+")) >= 3) & ~F.contains(capitals, F.lit(",")), capitals)
    return rules if known is None else F.when(F.array_contains(known, t), t).otherwise(rules)


def carry_sections(lines: DataFrame, key: str, order: str) -> DataFrame:
    """lines with section: the last heading at or before each line of its document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", heading(F.col("line"))).withColumn("section", F.last("heading", ignorenulls=True).over(w))


def pack(lengths: Column, target: int) -> Column:
    """Greedy packing of consecutive pieces: the group of each, a new one where the target would be passed."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(acc, n):
        full = (acc["sum"] + n > target) & (acc["sum"] > 0)
        group = acc["group"] + F.when(full, 1).otherwise(0)
        return F.struct(F.when(full, n).otherwise(acc["sum"] + n).alias("sum"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    return F.aggregate(lengths, start, step, lambda acc: acc["groups"])


def chunk_documents(docs: DataFrame, key: str, target: int = 500) -> DataFrame:
    """(key, chunk_index, text, n_tokens): consecutive lines packed to target tokens; native, a row at a time."""
    split = docs.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    sized = split.withColumn("_n", F.transform("_lines", count_tokens)).withColumn("_g", pack(F.col("_n"), target))
    rows = sized.select(key, F.explode(F.arrays_zip("_lines", "_n", "_g")).alias("x")).select(key, F.col("x._g").alias("chunk_index"), F.col("x._lines").alias("line"), F.col("x._n").alias("n"))
    # pieces of a document come from one row, in order, so the lists keep it
    return rows.groupBy(key, "chunk_index").agg(F.array_join(F.collect_list("line"), "\n").alias("text"), F.sum("n").alias("n_tokens"))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def context_header(*parts: tuple[str, Column]) -> Column:
    """[Name: value | ...]; null values are left out."""
    return F.concat(F.lit("["), F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), value) for name, value in parts]), F.lit("]"))
