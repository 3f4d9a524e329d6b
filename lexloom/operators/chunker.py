"""Documents of pages cut into chunks: sections carried over pages, greedy packing with overlap, tables by rows.

One narrow Arrow pass; a document is cut inside its row, so nothing is shuffled and the order of pages needs no sort. Tokens
never span white space, so the tokens of a text are the sum of those of its parts and each is counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import chunk

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
# Fixed value: where a sentence ends and another begins.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9•(])")
_SHAPES = {name: re.compile(getattr(chunk, name)) for name in ("MARKDOWN", "SECTION_WORD", "NUMBERED", "LEADING_CAPS")}


@dataclass(frozen=True)
class Sizes:
    """Tokens of a chunk: wanted, most of a piece of a table, least before a new section closes it, and carried over."""

    target: int = 500
    most: int = 650
    least: int = 80
    overlap: int = 80


class Piece(NamedTuple):
    text: str
    n: int
    glue: str = "\n"


def count(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def heading_of(line: str, known: frozenset[str] | set[str] = frozenset()) -> str | None:
    """As ``chunk.heading``, for a stripped line."""
    if line in known:
        return line
    if m := _SHAPES["MARKDOWN"].match(line):
        return m[1].strip()
    if chunk.COLUMN_BREAK in line:
        return None
    stopped = line.endswith((".", ",", ";"))
    shouted = line.isupper() and 2 <= len(line.split()) <= 10 and len(line) <= 80 and not stopped and sum(map(str.isalpha, line)) >= 4
    if (_SHAPES["SECTION_WORD"].match(line) and not line.endswith(".")) or (_SHAPES["NUMBERED"].match(line) and ":" not in line) or shouted:
        return line
    m = _SHAPES["LEADING_CAPS"].match(line)
    capitals = m[1].strip() if m else ""
    return capitals if len(capitals.split()) >= 3 and "," not in capitals else None


def units(text: str, known: set[str], section: str | None) -> Iterator[tuple[str | None, str]]:
    """(section, paragraph) of a page: blank lines and headings part paragraphs, a heading stays in its own. At the end
    (section, "") tells the section that is still open."""
    held: list[str] = []
    for line in map(str.strip, text.splitlines()):
        found = heading_of(line, known) if line else None
        if held and (found or not line):
            yield section, "\n".join(held)
            held = []
        section = found or section
        if line:
            held.append(line)
    if held:
        yield section, "\n".join(held)
    yield section, ""


def _atoms(text: str, limit: int) -> Iterator[Piece]:
    """Lines, of those over the limit sentences, of those over the limit runs of tokens."""
    for line in text.split("\n"):
        if (n := count(line)) <= limit:
            yield Piece(line, n)
            continue
        for sentence in SENTENCE_END.split(line):
            spans = [m.span() for m in _TOKEN.finditer(sentence)]
            if len(spans) <= limit:
                yield Piece(sentence, len(spans), " ")
                continue
            for at in range(0, len(spans), limit):
                run = spans[at : at + limit]
                yield Piece(sentence[run[0][0] : run[-1][1]], len(run), " ")


def split_long(text: str, limit: int) -> list[Piece]:
    """A text in pieces of at most limit tokens, each as full as its lines, sentences or tokens allow."""
    if (n := count(text)) <= limit:
        return [Piece(text, n)]
    out: list[Piece] = []
    for a in _atoms(text, limit):
        if out and out[-1].n + a.n <= limit:
            out[-1] = Piece(out[-1].text + a.glue + a.text, out[-1].n + a.n)
        else:
            out.append(a)
    return out


def overlap_tail(paragraph: str, limit: int) -> Piece | None:
    """The last sentences of a paragraph that fit the limit."""
    tail: list[str] = []
    n = 0
    for sentence in SENTENCE_END.split(paragraph)[::-1]:
        n += count(sentence)
        if n > limit:
            break
        tail.append(sentence)
    text = " ".join(tail[::-1])
    return Piece(text, count(text)) if tail else None


def pack(found: list[tuple[str | None, str]], sizes: Sizes) -> list[tuple[str | None, str]]:
    """(section, text): pieces put together up to the target; a new section closes a chunk that is long enough; within a
    section the next chunk begins with the end of the last."""
    out: list[tuple[str | None, str]] = []
    held: list[Piece] = []
    named: str | None = None
    for section, paragraph in found:
        for piece in split_long(paragraph, sizes.target):
            n = sum(p.n for p in held)
            changed = section != named
            if held and ((changed and n >= sizes.least) or n + piece.n > sizes.target):
                out.append((named, "\n\n".join(p.text for p in held)))
                tail = None if changed else overlap_tail(held[-1].text, sizes.overlap)
                held = [tail] if tail else []
            named = named if held else section
            held.append(piece)
    if held:
        out.append((named, "\n\n".join(p.text for p in held)))
    return out


def table_pieces(markdown: str, limit: int) -> list[str]:
    """A Markdown table, if over the limit in pieces by rows, each with the two head lines."""
    if count(markdown) <= limit:
        return [markdown]
    lines = markdown.split("\n")
    head, out = lines[:2], []
    room = limit - sum(map(count, head))
    for row in lines[2:]:
        n = count(row)
        if out and out[-1][1] + n <= room:
            out[-1] = [*out[-1][0], row], out[-1][1] + n
        else:
            out.append(([row], n))
    return ["\n".join([*head, *rows]) for rows, _ in out]


def cut(pages: list[dict], sizes: Sizes = Sizes()) -> list[tuple]:
    """(page, section, is_table, text, n_tokens) of a document's pages (page, text, headings, tables), in order."""
    known = {h.strip() for p in pages for h in p["headings"] or ()}
    section, out = None, []
    for p in pages:
        tables = p["tables"] or ()
        if not (p["text"] or "").strip() and not tables:
            continue
        *found, (section, _) = units(p["text"] or "", known, section)
        out += [(p["page"], s, False, t, count(t)) for s, t in pack(found, sizes)]
        out += [(p["page"], section, True, t, count(t)) for whole in tables for t in table_pieces(whole, sizes.most)]
    return out


PAGE = "struct<page: int, text: string, headings: array<string>, tables: array<string>>"


def chunk_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """docs (collection, file_name, doc_type, addendum_number, pages ARRAY<PAGE>) as chunks: collection, file_name, page,
    chunk_index, chunk_id, section, is_table, text, header, n_tokens. Null or empty pages give no chunk; repeated documents give
    their chunks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, f, i, *x) for c, f, pages in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for i, x in enumerate(cut(pages or [], sizes))]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["_meta", "file_name", "chunk_index", "page", "section", "is_table", "text", "n_tokens"])

    meta = F.to_json(F.struct("collection", F.coalesce("doc_type", F.lit("other")).alias("doc_type"), F.col("addendum_number").cast("int").alias("addendum_number")))
    rows = docs.select(meta.alias("_meta"), "file_name", F.transform("pages", lambda p: F.struct(*[p[c].alias(c) for c in ("page", "text", "headings", "tables")])).cast(f"array<{PAGE}>").alias("pages"))
    made = rows.mapInArrow(run, "_meta string, file_name string, chunk_index int, page int, section string, is_table boolean, text string, n_tokens int")
    made = made.withColumn("_m", F.from_json("_meta", "collection string, doc_type string, addendum_number int")).select("_m.*", "file_name", "page", "chunk_index", "section", "is_table", "text", "n_tokens")
    kind = F.concat(F.replace("doc_type", F.lit("_"), F.lit(" ")), F.coalesce(F.concat(F.lit(" #"), F.nullif("addendum_number", F.lit(0)).cast("string")), F.lit("")))
    stem = F.replace(F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    said = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    header = F.concat(F.lit("["), F.concat_ws(" | ", said("Bid: ", F.col("collection")), said("Doc: ", F.concat(stem, F.lit(" ("), kind, F.lit(")"))), said("Page ", F.col("page")), said("Section: ", F.col("section"))), F.lit("]"))
    name = F.concat_ws("/", "collection", "file_name", F.col("page").cast("string"), F.col("chunk_index").cast("string"))
    return made.select("collection", "file_name", "page", "chunk_index", chunk.uuid5(name).alias("chunk_id"), "section", "is_table", "text", header.alias("header"), "n_tokens")


def statistics(chunks: DataFrame) -> DataFrame:
    """Chunks, tables, mean tokens (whole), most tokens and sections (none counts as one) of each file."""
    return chunks.groupBy("collection", "file_name").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_table").alias("tables"), F.floor(F.avg("n_tokens")).alias("avg_tokens"), F.max("n_tokens").alias("max_tokens"), F.count_distinct(F.coalesce("section", F.lit("\0"))).alias("sections"))
