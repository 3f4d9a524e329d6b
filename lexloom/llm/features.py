"""Hashed indicator features of whole texts for the linear and factorised classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lexloom.llm import textbytes as tb

SHAPE_ORDERS = (1, 2, 3, 4, 5, 6)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[[9, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[48:58] = _LETTER[128:] = True


def _distinct(doc: np.ndarray, h: np.ndarray, n: int, slots: int) -> Iterator[np.ndarray]:
    """The distinct slots of each document, from pairs of document and hash in any order."""
    key = np.unique(doc.astype(np.int64) * slots + (h % np.uint64(slots)).astype(np.int64))
    at = np.searchsorted(key, np.arange(n + 1) * slots)
    key %= slots
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield key[a:b]


def shapes(data: np.ndarray, off: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """n-grams of the run-length-folded sequence of byte kinds, of words with their order 2 repeats, and of words.

    "Then THEM!!" folds to "Aa A!": the n-grams of such shapes tell ordinary prose from shouting, symbol soup and
    lists; the repeat grams (is a word equal to one of the two before it?) tell it from stuttering.
    """
    n = len(off) - 1
    point = np.repeat(np.arange(n), np.diff(off))
    kind = _SHAPE[data]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (point[1:] != point[:-1])
    kind, where = kind[first].astype(np.uint64), point[first]
    docs, hashes = [], []
    for k in SHAPE_ORDERS:
        if len(kind) >= k:
            ok = where[: len(where) - k + 1] == where[k - 1 :]
            code = np.full(len(kind) - k + 1, k, np.uint64)
            for i in range(k):
                code = code * np.uint64(257) + kind[i : len(kind) - k + 1 + i]
            # few distinct shapes: fold to distinct ones before they are hashed and paired with documents
            docs.append(where[: len(where) - k + 1][ok])
            hashes.append(tb.mix(code[ok]))
    s, e, wfirst = tb.spans(data, off, tb.NOT_SPACE)
    if len(s):
        doc = tb.per_document(wfirst)
        words = tb.span_hash(tb.prefix_hash(tb.LOWER[data]), s, e)
        same = np.zeros(len(s), np.uint64)
        same[1:] |= ((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])).astype(np.uint64)
        same[2:] |= ((words[2:] == words[:-2]) & (doc[2:] == doc[:-2])).astype(np.uint64) << np.uint64(1)
        for k in (1, 2, 3):
            if len(s) >= k:
                ok = doc[: len(doc) - k + 1] == doc[k - 1 :]
                code = np.full(len(s) - k + 1, 1000 + k, np.uint64)
                for i in range(k):
                    code = code * np.uint64(5) + same[i : len(s) - k + 1 + i]
                docs.append(doc[: len(doc) - k + 1][ok])
                hashes.append(tb.mix(code[ok] + np.uint64(1 << 40)))
        docs.append(doc)
        hashes.append(words)
    if not docs:
        docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    return _distinct(np.concatenate(docs), np.concatenate(hashes), n, slots)


def terms(data: np.ndarray, off: np.ndarray, slots: int, stems: tuple[int, ...] = (4, 5)) -> Iterator[np.ndarray]:
    """Words (letters and digits, lower-cased A-Z) and their first 4 and 5 bytes, so that inflected forms share a term."""
    n = len(off) - 1
    data = tb.LOWER[data]
    s, e, first = tb.spans(data, off, _LETTER)
    doc = tb.per_document(first)
    h = tb.prefix_hash(data)
    docs, hashes = [doc], [tb.span_hash(h, s, e)]
    for k in stems:
        long = e - s >= k
        docs.append(doc[long])
        hashes.append(tb.mix(tb.span_hash(h, s[long], s[long] + k) + tb.MULTIPLIERS[k]))
    return _distinct(np.concatenate(docs), np.concatenate(hashes), n, slots)


def of_text(text: str, kind, slots: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return next(iter(kind(data, np.array([0, len(data)], np.int64), slots)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, with Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, d = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-9)
        h = np.array([[(d * margin**2).sum() + 1e-6, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
