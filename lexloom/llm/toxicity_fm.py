"""Toxicity: a second-order factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text, so that a pair (an insult and
the mention of a group) can weigh more than its parts. The fit takes at most ``ROWS_PER_CLASS`` labelled rows of each
class and ``store.SAMPLE_BYTES`` of text. Terms get parameters if their own counts differ between the classes beyond chance
(a G test), or if they are one of a pair whose joint counts differ beyond chance and by more than either term's own: a term as
frequent in both classes that is toxic only beside another one is found by its pairs. Pairs are counted, all at once, among
the ``PAIR_TERMS`` terms of the sample with most rows. What is left is a few hundred slots, and ordinary words of long
texts add no noise. Scoring is one narrow pass over whole texts.

Defined results: null and empty texts have no terms and get the score of the bias; labels that are null or neither 0 nor
1 are skipped, a doc_id labelled twice counts once with its lower label; without rows of both classes every score is the
smoothed share of label 1; repeated rows have equal scores; very long texts are scored whole; an empty table gives no rows;
columns named like the results are replaced, all others pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import features as ft
from lexloom.llm import textbytes as tb
from lexloom.llm.store import add_columns, labelled_sample

SLOTS = 1 << 20
FACTORS = 8
ROWS_PER_CLASS = 3000
THRESHOLD = 0.7
#: Least G of a term that gets parameters (chi-square of one degree: 1 in 10,000 is 15.1).
LEAST_G = 15.0
LEAST_ROWS = 3
#: Terms of the sample among which pairs are counted, least G of a pair, and by how much it must pass its terms' own.
PAIR_TERMS = 1024
LEAST_PAIR_G = 30.0
PAIR_GAIN = 15.0


@dataclass
class Model:
    index: np.ndarray  # slot -> place among the terms with parameters, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    offset: float

    def margin(self, x: np.ndarray) -> float:
        at = self.index[x]
        at = at[at >= 0]
        v = self.factors[at]
        s = v.sum(axis=0)
        return self.bias + self.linear[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())

    def score(self, x: np.ndarray) -> float:
        return float(ft.sigmoid(self.margin(x) + self.offset))


def _g(p: np.ndarray, q: np.ndarray, n: int, m: int) -> np.ndarray:
    """G of the presence in p of n toxic and q of m other rows against the classes; 0 where that is too few rows."""
    share = (p + q) / (n + m)

    def term(o, e):
        return np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / np.maximum(e, 1e-12)), 0)

    g = 2 * (term(p, n * share) + term(q, m * share) + term(n - p, n * (1 - share)) + term(m - q, m * (1 - share)))
    return np.where(p + q >= LEAST_ROWS, g, 0)


def chosen_terms(rows: list[np.ndarray], y: np.ndarray, slots: int) -> np.ndarray:
    """The slots that get parameters, by their own counts or by those of their pairs."""
    p, q = np.zeros(slots), np.zeros(slots)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    n, m = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    own = _g(p, q, n, m)
    single = own >= LEAST_G
    frequent = np.argsort(-(p + q), kind="stable")[:PAIR_TERMS]
    frequent = np.sort(frequent[p[frequent] + q[frequent] >= LEAST_ROWS])
    place = np.full(slots, -1)
    place[frequent] = np.arange(len(frequent))
    has = np.zeros((len(rows), len(frequent)), np.float32)
    for i, x in enumerate(rows):
        at = place[x]
        has[i, at[at >= 0]] = 1
    # counts up to 2^24 are whole numbers in single precision
    joint = [has[y == label].T @ has[y == label] for label in (1, 0)]
    for i in range(len(frequent)):
        g = _g(joint[0][i].astype(float), joint[1][i].astype(float), n, m)
        found = (g >= LEAST_PAIR_G) & (g >= np.maximum(own[frequent[i]], own[frequent]) + PAIR_GAIN)
        found[i] = False
        if found.any():
            single[frequent[i]] = True
    return np.flatnonzero(single)


def fit(samples: list[tuple[str, int]], share: float, slots: int = SLOTS, factors: int = FACTORS, rounds: int = 12, rate: float = 0.1, decay: float = 1e-3, seed: int = 11) -> Model:
    """Adagrad on the logistic loss, rows of both classes weighing the same; share: of label 1 among all labelled rows."""
    y = np.array([label for _, label in samples], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.full(slots, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, factors)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rows = [ft.of_text(t, ft.terms, slots) for t, _ in samples]
    chosen = chosen_terms(rows, y, slots)
    index = np.full(slots, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    rows = [r[r >= 0] for r in (index[x] for x in rows)]
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors))
    g0, gw, gv = 1e-6, np.full(len(chosen), 1e-6), np.full((len(chosen), factors), 1e-6)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            s = v[at].sum(axis=0)
            p = ft.sigmoid(w0 + w[at].sum() + 0.5 * ((s * s).sum() - (v[at] ** 2).sum()))
            d = weight[i] * (p - y[i])
            g0 += d * d
            w0 -= rate * d / np.sqrt(g0)
            if len(at):
                dw, dv = d + decay * w[at], d * (s - v[at]) + decay * v[at]
                gw[at] += dw * dw
                gv[at] += dv * dv
                w[at] -= rate * dw / np.sqrt(gw[at])
                v[at] -= rate * dv / np.sqrt(gv[at])
    return Model(index, w0, w.astype(np.float32), v.astype(np.float32), 0.0)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, slots: int = SLOTS) -> Model:
    n = {r[0]: r[1] for r in labels.where(allowed & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    return fit(labelled_sample(docs, labels, label, allowed, rows_per_class), share, slots)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: more likely toxic) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        m, out = shared.value, []
        for _, _, data, off in tb.runs(column):
            out += [m.score(x) for x in ft.terms(data, off, len(m.index))]
        p = np.array(out, float)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return add_columns(docs, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)
