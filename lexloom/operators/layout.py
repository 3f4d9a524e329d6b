"""Page layout: visual lines from placed words, headings by their type, and tables as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_GAP = 5.0
COLUMN_GAP = 15.0
PARAGRAPH_RATIO = 1.8
DEFAULT_SIZE = 10.0
HEADING_RATIO = 1.15
LAYOUT_CELL_CHARS = 150
FORM_EMPTY_RATIO = 0.4
LABEL_CHARS = 60
# Text that breaks off inside an e-mail address or a URL, and the beginning of a list item.
OPEN_ADDRESS = r"(?:@|https?://|www\.)\S*$"
LIST_ITEM = r"^(?:[0-9]+[.)]|[•▪\-–])\s"


def body_sizes(spans: DataFrame, key: str) -> DataFrame:
    """(key, body_size): the rounded size that most characters have; of equal ones the smaller. spans: key, size, text."""
    sums = spans.groupBy(key, F.round("size", 1).alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("weight"))
    best = sums.where("weight > 0").groupBy(key).agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body_size"))
    return spans.select(key).distinct().join(best, key, "left").select(key, F.coalesce("body_size", F.lit(DEFAULT_SIZE)).alias("body_size"))


def inside_any(x: Column, y: Column, boxes: Column) -> Column:
    """Whether a point is in one of boxes, an array of (x0, y0, x1, y1)."""
    return F.exists(boxes, lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """A short line, mostly of letters, that is larger than the body, all bold, or in capitals."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    shaped = F.length(t).between(3, 80) & (words <= 10) & ~F.lower(t).rlike(r"^page\s+[0-9]+") & (letters >= 0.6 * F.length(F.replace(t, F.lit(" "))))
    shouted = (t == F.upper(t)) & (t != F.lower(t)) & words.between(2, 8)
    return shaped & ((size >= body * HEADING_RATIO) | (((bold & (words >= 2)) | shouted) & ~t.rlike("[.,;]$")))


def page_headings(lines: DataFrame, key: str, sizes: DataFrame, boxes: str | None = None) -> DataFrame:
    """(key, headings): the headings of each page in the order of its lines, outside of tables. lines: key, line, text, size, bold
    and, if boxes names a column of boxes, x and y; sizes: as of ``body_sizes``, by the same key."""
    rows = lines.join(sizes, key).where(is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size")))
    if boxes:
        rows = rows.where(~inside_any(F.col("x"), F.col("y"), F.coalesce(boxes, F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>"))))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("text")))), lambda x: x["text"]).alias("headings"))


def outside_tables(words: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """words (key, y, x0, x1, ...) without those whose centre is in one of their page's boxes (key, boxes)."""
    both = words.join(boxes.select(key, "boxes"), key, "left")
    return both.where(F.col("boxes").isNull() | ~inside_any((F.col("x0") + F.col("x1")) / 2, F.col("y"), F.col("boxes"))).drop("boxes")


def tables_text(rows: Column) -> Column:
    """A table's rows as (markdown, text), the one null where the other is: data as Markdown, layout or a single row as text."""
    n = normalise_rows(rows)
    prose = is_layout(n) | (F.size(n) < 2)
    return F.struct(F.when(~prose, rows_markdown(n)).alias("markdown"), F.when(prose, rows_text(n)).alias("text"))


def anchored_groups(positions: Column, tolerances: Column) -> Column:
    """The group of each of ascending positions; a new one starts where a position is past its group's first by more
    than the tolerance there. The first position decides, not the last one, so slow drifts don't merge lines."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(acc, p):
        fresh = acc["first"].isNull() | (p["at"] - acc["first"] > p["room"])
        group = acc["group"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, p["at"]).otherwise(acc["first"]).alias("first"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    pairs = F.zip_with(positions, tolerances, lambda a, r: F.struct(a.cast("double").alias("at"), r.cast("double").alias("room")))
    return F.aggregate(pairs, start, step, lambda acc: acc["groups"])


def visual_lines(words: DataFrame, key: str, gap: float = LINE_GAP) -> DataFrame:
    """(key, line, text, top, height): lines of words in reading order. words: key, y (centre), x0, x1, height, text.

    Words of a line are parted by a space, across a column break by three. A page is one array; pages are independent.
    """
    sorted_words = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1", "height", "text"))).alias("_w"))
    grouped = sorted_words.withColumn("_g", anchored_groups(F.transform("_w", lambda w: w["y"]), F.transform("_w", lambda w: F.lit(gap))))
    return _line_texts(grouped, key, COLUMN_GAP)


def _line_texts(grouped: DataFrame, key: str, column_gap: float | None) -> DataFrame:
    rows = grouped.select(key, F.explode(F.arrays_zip("_w", "_g")).alias("_pair")).select(key, F.col("_pair._g").alias("line"), "_pair._w.*")
    lines = rows.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("ws"), F.min("y").alias("top"), F.max("height").alias("height"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def step(acc, w):
        wide = F.lit(False) if column_gap is None else w["x0"] - acc["end"] > column_gap
        glue = F.when(acc["end"].isNull(), "").when(wide, "   ").otherwise(" ")
        return F.struct(F.concat(acc["text"], glue, w["text"]).alias("text"), w["x1"].cast("double").alias("end"))

    return lines.select(key, "line", F.aggregate("ws", start, step, lambda acc: acc["text"]).alias("text"), "top", "height")


def ocr_lines(boxes: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """(key, line, text, top, height): recognised boxes in reading order; a box goes on a line if its centre differs from that of
    the line's first box by at most ratio of the greater of the two heights. boxes: key, y, x0, x1, height, text."""
    whole = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1", "height", "text"))).alias("_w"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("h"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(acc, w):
        fresh = acc["y"].isNull() | (F.abs(w["y"] - acc["y"]) > F.greatest(w["height"], acc["h"]) * ratio)
        group = acc["group"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, w["y"].cast("double")).otherwise(acc["y"]).alias("y"), F.when(fresh, w["height"].cast("double")).otherwise(acc["h"]).alias("h"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    return _line_texts(whole.withColumn("_g", F.aggregate("_w", start, step, lambda acc: acc["groups"])), key, None)


def page_text(lines: DataFrame, key: str, ratio: float = PARAGRAPH_RATIO) -> DataFrame:
    """(key, text): lines put together; a step down of more than ratio times the upper median height is a blank line."""
    heights = lines.groupBy(key).agg(F.array_sort(F.collect_list("height")).alias("_h")).select(key, F.element_at("_h", F.floor(F.size("_h") / 2).cast("int") + 1).alias("_median"))
    w = Window.partitionBy(key).orderBy("line")
    step = lines.withColumn("_gap", F.col("top") - F.lag("top").over(w)).join(heights, key)
    part = F.concat(F.when(F.col("_gap") > F.col("_median") * ratio, "\n").otherwise(""), "text")
    ordered = step.select(key, F.struct("line", part.alias("part")).alias("_p")).groupBy(key).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return ordered.select(key, F.array_join(F.transform("_p", lambda p: p["part"]), "\n").alias("text"))


def join_cell(cell: Column) -> Column:
    """Wrapped lines of a cell in one; without a space inside an e-mail address or URL, unless a list item follows."""
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.concat(acc, F.when((acc == "") | (acc.rlike(OPEN_ADDRESS) & ~p.rlike(LIST_ITEM)), "").otherwise(" "), p))


def normalise_rows(rows: Column) -> Column:
    """Rows of joined cells, padded to one width, without rows and columns that are all empty."""
    full = F.filter(F.transform(rows, lambda row: F.transform(row, join_cell)), lambda row: F.exists(row, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(full, F.size)), F.lit(0))
    padded = F.transform(full, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))))
    indexes = F.when(width > 0, F.sequence(F.lit(1), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    keep = F.filter(indexes, lambda i: F.exists(padded, lambda row: F.element_at(row, i) != ""))
    return F.transform(padded, lambda row: F.transform(keep, lambda i: F.element_at(row, i)))


def is_layout(rows: Column) -> Column:
    """Whether normalised rows are boxed prose or a sparse form: one column, two of long cells, or many empty cells."""
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: c != "")
    chars = F.aggregate(filled, F.lit(0), lambda acc, c: acc + F.length(c))
    n_cols = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    some = F.greatest(F.size(filled), F.lit(1))
    return (n_cols == 1) | ((n_cols == 2) & (chars / some > LAYOUT_CELL_CHARS)) | (1 - F.size(filled) / F.greatest(F.size(cells), F.lit(1)) >= FORM_EMPTY_RATIO)


def rows_text(rows: Column) -> Column:
    """Rows as paragraphs: a short cell and another as label and value, else cells between bars."""
    def line(row):
        cells = F.filter(row, lambda c: c != "")
        label, value = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
        pair = F.concat(label, F.when(label.endswith(":"), " ").otherwise(": "), value)
        return F.when((F.size(cells) == 2) & (F.length(label) < LABEL_CHARS), pair).otherwise(F.array_join(cells, " | "))

    return F.array_join(F.transform(rows, line), "\n\n")


def rows_markdown(rows: Column) -> Column:
    """Rows as a Markdown table, the first one its head; bars in cells are escaped."""
    lines = F.transform(rows, lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")
