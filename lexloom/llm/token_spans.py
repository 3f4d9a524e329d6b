"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level BPE whose tokens are consecutive bytes of the text, so running
sums of the tokens' byte lengths, mapped to characters (code points), are their character spans; a token that begins or ends
inside a character spans the whole of it. The spans are joined with the spans of the sections, both sorted, by binary search.
Sections are a text's lines (a line's break belongs to it) or named fields: columns put together to one text, each with
the separator behind it. A token that crosses a boundary goes by an explicit rule:

* ``start`` (default): whole to the section of its first character;
* ``end``: whole to the section of its last character;
* ``share``: to each section in proportion to its characters in it.

Totals over a document's sections are its token count under each rule. The vocabulary file is read on the driver, from any
path that Spark reads, and broadcast (its size is checked against ``MOST_BYTES``), so executors need no copy of their own.

Defined results: a null or empty text has one section (0) without tokens, a null or empty field a section without tokens
beyond its separator's; blank lines are sections like others; a final line break ends its line and opens no section; repeated
rows have equal results; very long texts, with or without blanks, are encoded whole; special tokens' strings are ordinary
text; an empty table gives no rows. Other columns of docs, whatever their names, don't take part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.store import quoted

#: The tokenizer's file of ranks and the pattern of pieces it goes with.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "share")
#: Most bytes of a vocabulary file that is broadcast.
MOST_BYTES = 64 << 20


@lru_cache(2)
def encoder(ranks_file: bytes, pattern: str = PATTERN):
    """The tokenizer of a file of ranks and the byte length of each of its tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("lexloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def vocabulary(spark: SparkSession, path: str = RANKS) -> bytes:
    """The bytes of a vocabulary file: of the driver's own disk, or where the path has a scheme, by Spark."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"]) if "://" in path else Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than {MOST_BYTES}")
    return data


def line_ends(text: str) -> np.ndarray:
    """End offsets, in characters, of the lines of a text, their breaks included; [0] for an empty one."""
    at = np.array([m.end() for m in re.finditer("\n", text)], np.int64)
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text)).astype(np.int64)


def token_spans(text: str, bpe, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token, in characters."""
    ends = np.cumsum(lengths[np.array(bpe.encode_ordinary(text), np.int64)])
    if len(text) == (ends[-1] if len(ends) else 0):
        return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends
    first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    character = np.cumsum(first) - 1  # of each byte
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return character[starts], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (whole numbers, or shares) and how many tokens cross its end. Empty sections get none."""
    n = len(section_ends)
    a, b = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, ends - 1, "right")
    over = a != b
    crossing = np.zeros(n + 1, np.int64)
    np.add.at(crossing, a[over], 1)
    np.subtract.at(crossing, b[over], 1)
    crossing = np.cumsum(crossing)[:n]
    if rule != "share":
        return np.bincount(a if rule == "start" else b, minlength=n).astype(float)[:n], crossing
    out = np.bincount(a[~over], minlength=n).astype(float)
    for i in np.flatnonzero(over).tolist():
        edges = np.clip(np.concatenate([[starts[i]], section_ends[a[i] : b[i]], [ends[i]]]), starts[i], ends[i])
        out[a[i] : b[i] + 1] += np.diff(edges) / (ends[i] - starts[i])
    return out, crossing


def _counted(docs: DataFrame, bounds, name: str, kind: str, rule: str, path: str, pattern: str) -> DataFrame:
    """bounds: a row's columns after the first -> text, names and ends of its sections."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(spark, path))
    key = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lengths = encoder(shared.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, names, start, end, tokens, crossing, total = [], [], [], [], [], [], []
                for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text, own, ends = bounds(values)
                    spans = token_spans(text, bpe, lengths)
                    n, over = attribute(*spans, ends, rule)
                    ids += [doc_id] * len(n)
                    names += own
                    start.append(np.concatenate([[0], ends[:-1]]))
                    end.append(ends)
                    tokens.append(n)
                    crossing.append(over)
                    total.append(np.full(len(n), len(spans[0])))
                join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), pa.array(names, pa.int32() if kind == "int" else pa.string()), pa.array(join(start), pa.int64()), pa.array(join(end), pa.int64()), pa.array(join(tokens), pa.float64()), pa.array(join(crossing), pa.int64()), pa.array(join(total), pa.int64())],
                    names=[key, name, "start_char", "end_char", "n_tokens", "crossing", "doc_tokens"],
                )

    return docs.mapInArrow(run, f"`{key}` {docs.schema[0].dataType.simpleString()}, {name} {kind}, start_char long, end_char long, n_tokens double, crossing long, doc_tokens long")


def _lines(values: list) -> tuple[str, list, np.ndarray]:
    text = values[0] or ""
    ends = line_ends(text)
    return text, list(range(len(ends))), ends


def count_sections(docs: DataFrame, rule: str = "start", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """A row for each line: doc_id, section, start_char, end_char, n_tokens, crossing, doc_tokens."""
    return _counted(docs.select("doc_id", "text"), _lines, "section", "int", rule, path, pattern)


def count_fields(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "start", key: str = "doc_id", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """A row for each of the columns ``fields``, put together in their order: key, field, start_char, end_char, n_tokens,
    crossing, doc_tokens."""

    def bounds(values: list) -> tuple[str, list, np.ndarray]:
        parts = [(v or "") + (separator if i < len(values) - 1 else "") for i, v in enumerate(values)]
        return "".join(parts), list(fields), np.cumsum([len(p) for p in parts])

    return _counted(docs.select(quoted(key), *[quoted(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]), bounds, "field", "string", rule, path, pattern)
