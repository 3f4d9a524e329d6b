"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with the references
of several languages by Jensen-Shannon distance. The references are learned from all documents that pass the base
rules: for each language the Hellinger mean of its documents' normalised histograms (the mean of their square roots,
squared): each document weighs the same, and a minority of junk leaves hardly a trace. A document is kept if some language lies near enough in both histograms.

Defined results: null and empty texts have no words, fail the base rules and are not kept; documents below the
minimum length are never judged by divergence (the base rules reject them); with no reference at all (an empty
table, or no language of ``COMMON_WORDS``) the base rules alone decide; repeated rows get equal verdicts; columns
named like the results are replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import textbytes as tb
from lexloom.llm.store import add_columns

#: Words that make up much of any ordinary text of the language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la les avec son ou aux cette ses mais comme on elle nous leur".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
}
MIN_WORDS = 50
CHAR_LIMIT = 0.14
WORD_LIMIT = 0.40
#: A short text strays by chance, or by one telephone number: the limits are widened by this over sqrt(n_words).
CHAR_NOISE = 0.7
WORD_NOISE = 1.6
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other")

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[192:] = 0, 1, 2, 3, 4, 0
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_CLASS[:9] = _CLASS[14:32] = 7
_CLASS[128:192] = 255  # continuation bytes are no code points
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?\"'()"]] = True


class Vocabulary:
    """Hashes of the common words, with the bin of each; the last bin holds all other words."""

    def __init__(self, common: dict[str, list[str]]):
        words = sorted({w for ws in common.values() for w in ws})
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        h = tb.span_hash(tb.prefix_hash(data), off[:-1], off[1:])
        order = np.argsort(h)
        self.hashes, self.bins, self.n = h[order], order, len(words) + 1

    def look(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.bins[at], self.n - 1)


def measure(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary | None) -> dict[str, np.ndarray]:
    """The base counts of each document of a run and, with a vocabulary, its two histograms."""
    n = len(off) - 1
    s, e, first = tb.spans(data, off, tb.NOT_SPACE)
    doc = tb.per_document(first)
    code_point = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": tb.sums(code_point & tb.NOT_SPACE[data], off), "n_symbols": tb.sums(_SYMBOL[data], off)}
    h = tb.prefix_hash(data)

    is_line = np.ones(256, bool)
    is_line[10] = False
    ls, le, lfirst = tb.spans(data, off, is_line)
    worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, ldoc = ls[worded], le[worded], tb.per_document(lfirst)[worded]
    line = tb.mix(tb.span_hash(h, ls, le) + ldoc.astype(np.uint64) * tb.MULTIPLIERS[40])
    _, where = np.unique(line, return_index=True)
    out["n_dup_lines"] = np.bincount(ldoc, minlength=n) - np.bincount(ldoc[where], minlength=n)

    words = tb.span_hash(h, s, e)
    repeat = np.zeros(len(s) + 1, np.int64)
    if len(s) >= 3:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = tb.mix(tb.window_hash(words, 3)[inside] + doc[inside].astype(np.uint64) * tb.MULTIPLIERS[41])
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        at = inside[count[back] > 1]
        repeat[at] += 1
        np.subtract.at(repeat, at + 3, 1)
    out["n_repeat_words"] = tb.sums(np.cumsum(repeat[:-1]) > 0, first)
    if vocabulary is not None:
        kind = _CLASS[data]
        point = np.repeat(np.arange(n), np.diff(off))
        keep = kind != 255
        out["chars"] = np.bincount(point[keep] * len(CLASSES) + np.minimum(kind[keep], 7), minlength=n * len(CLASSES)).reshape(n, -1)
        lower = tb.LOWER[data]
        # a word loses one stop at its end; a common word never begins with one
        trimmed = e - (_STOP[data[e - 1]] & (e - s > 1)) if len(s) else e
        bins = vocabulary.look(tb.span_hash(tb.prefix_hash(lower), s, trimmed))
        out["words"] = np.bincount(doc * vocabulary.n + bins, minlength=n * vocabulary.n).reshape(n, -1)
    return out


def base_failed(m: dict[str, np.ndarray], min_words: int = MIN_WORDS) -> np.ndarray:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of p from each row of q."""
    out = np.zeros((len(p), len(q)))

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=1)

    hp, hq = entropy(p), entropy(q)
    for j in range(len(q)):
        out[:, j] = np.sqrt(np.maximum(0, entropy((p + q[j]) / 2) - (hp + hq[j]) / 2))
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1, x.sum(axis=1, keepdims=True))


def learn_references(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Per language the Hellinger mean histograms of all documents that pass the base rules.

    Each task adds up its own documents, so that a row for each language and task is shuffled; the result has a row
    for each language of ``common``.
    """
    vocabulary = Vocabulary(common)
    names = sorted(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(CLASSES) + vocabulary.n + 1))
        for batch in batches:
            lang = np.array([names.index(x) if x in common else -1 for x in batch.column(1).to_pylist()])
            for i, j, data, off in tb.runs(batch.column(0)):
                m = measure(data, off, vocabulary)
                ok = ~base_failed(m, min_words) & (lang[i:j] >= 0)
                x = np.hstack([np.sqrt(_normal(m["chars"])), np.sqrt(_normal(m["words"])), np.ones((j - i, 1))])
                np.add.at(total, lang[i:j][ok], x[ok])
        bins = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, bins)), pa.array(np.tile(np.arange(bins, dtype=np.int32), len(names))), pa.array(total.ravel())], names=["lang", "bin", "total"])

    added = docs.select("text", "lang").mapInArrow(run, "lang string, bin int, total double")
    out = {x: np.zeros(len(CLASSES) + vocabulary.n + 1) for x in names}
    for r in added.groupBy("lang", "bin").agg(F.sum("total").alias("total")).collect():
        out[r["lang"]][r["bin"]] = r["total"]
    found = {k: (v[:-1] / v[-1]) ** 2 for k, v in out.items() if v[-1] > 0}
    n = len(CLASSES)
    return {k: np.concatenate([v[:n] / max(v[:n].sum(), 1e-12), v[n:] / max(v[n:].sum(), 1e-12)]) for k, v in found.items()}


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("char_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def judge(docs: DataFrame, references: dict[str, np.ndarray], common: dict[str, list[str]] = COMMON_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the counts, both distances (from the nearest language) and the verdict; no shuffle."""
    vocabulary = Vocabulary(common)
    table = np.array([references[k] for k in sorted(references)]).reshape(len(references), len(CLASSES) + vocabulary.n)
    chars, words = table[:, : len(CLASSES)], table[:, len(CLASSES) :]

    def work(column: pa.Array) -> list[pa.Array]:
        parts: list[list[np.ndarray]] = [[] for _ in FIELDS]
        for _, _, data, off in tb.runs(column):
            m = measure(data, off, vocabulary)
            failed = base_failed(m, min_words)
            dc, dw, kept = np.zeros(len(failed)), np.zeros(len(failed)), ~failed
            if len(table):
                root = np.sqrt(np.maximum(1, m["n_words"]))
                slack_c, slack_w = CHAR_NOISE / root, WORD_NOISE / root
                a, b = distance(_normal(m["chars"]), chars), distance(_normal(m["words"]), words)
                near = np.argmin(np.maximum(a / (char_limit + slack_c)[:, None], b / (word_limit + slack_w)[:, None]), axis=1)
                rows = np.arange(len(failed))
                dc, dw = a[rows, near], b[rows, near]
                kept = ~failed & (dc <= char_limit + slack_c) & (dw <= word_limit + slack_w)
            for part, x in zip(parts, [m[f.name] for f in FIELDS[:5]] + [failed, dc, dw, kept], strict=True):
                part.append(x)
        return [pa.array(np.concatenate(p) if p else np.zeros(0), pa.int64() if f.dataType == T.LongType() else pa.bool_() if f.dataType == T.BooleanType() else pa.float64()) for p, f in zip(parts, FIELDS, strict=True)]

    return add_columns(docs, "text", FIELDS, work)


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """References from all of docs, then the verdict on each."""
    return judge(docs, learn_references(docs), **limits)
