"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the class log-count ratios; on them a linear hinge-loss model is fitted by
dual coordinate descent. The fit takes at most ``ROWS_PER_CLASS`` labelled rows of each class (chosen by a hash of the
id); a logistic curve, fitted on margins of rows held out of a first fit, turns margins into scores, at the class
shares of all labelled rows. Scoring is one narrow pass over the whole texts.

Defined results: null and empty texts have no n-grams and get the score of the bias; labels that are null or neither 0
nor 1 are skipped, a doc_id labelled twice counts once with its lower label; without rows of both classes each score is
the smoothed share of label 1; columns named like the results are replaced.
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

SLOTS = 1 << 18
ROWS_PER_CLASS = 3000
THRESHOLD = 0.3


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, slots: int, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(slots, smooth), np.full(slots, smooth)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on the scaled indicators and bias of the L1-loss support vector machine, by dual coordinate descent.

    Each row is brought to unit length, so that a long text does not outweigh the others; the weights returned are for
    the scaled indicators of a row divided by their length (see ``Scaled``).
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[x] for x in rows]
    norms = [max(np.sqrt((v * v).sum()), 1e-9) for v in values]
    values = [v / n for v, n in zip(values, norms, strict=True)]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * ((w[rows[i]] * values[i]).sum() + bias) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost[i])  # the row and its bias have the square length 2
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * values[i]
                bias += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Scaled:
    """A fitted model; a row's margin is the scaled weights' sum over the scaled indicators' length."""

    product: np.ndarray
    square: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        return float(self.product[x].sum() / max(np.sqrt(self.square[x].sum()), 1e-9)) + self.bias if len(x) else self.bias

    def score(self, x: np.ndarray) -> float:
        return float(ft.sigmoid(self.slope * self.margin(x) + self.offset))


def fit(samples: list[tuple[str, int]], share: float, slots: int = SLOTS, c: float = 1.0) -> Scaled:
    """share: of label 1 among all labelled rows."""
    y = np.array([1 if label == 1 else -1 for _, label in samples])
    if len(set(y.tolist())) < 2:
        return Scaled(np.zeros(slots), np.zeros(slots), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rows = [ft.of_text(t, ft.shapes, slots) for t, _ in samples]

    def machine(at: np.ndarray) -> Scaled:
        some, yy = [rows[i] for i in at], y[at]
        r = log_count_ratios(some, yy, slots)
        cost = c * np.where(yy > 0, len(yy) / (2 * max(1, (yy > 0).sum())), len(yy) / (2 * max(1, (yy < 0).sum())))
        w, b = dual_descent(some, yy, r, cost)
        return Scaled((w * r).astype(np.float32), (r * r).astype(np.float32), b)

    every = np.arange(len(rows))
    margins = np.zeros(len(rows))
    for k in range(3):
        rest, held = every[every % 3 != k], every[every % 3 == k]
        if len(set(y[rest].tolist())) < 2:
            margins[held] = 0
            continue
        part = machine(rest)
        margins[held] = [part.margin(rows[i]) for i in held]
    pos = (y > 0).mean()
    weight = np.where(y > 0, share / pos, (1 - share) / (1 - pos))
    model = machine(every)
    model.slope, model.offset = ft.platt(margins, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, slots: int = SLOTS) -> Scaled:
    counts = labels.where(allowed & F.col(label).isin(0, 1)).groupBy(label).count().collect()
    n = {r[0]: r[1] for r in counts}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    return fit(labelled_sample(docs, labels, label, allowed, rows_per_class), share, slots)


def score(docs: DataFrame, model: Scaled, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: better) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        m, out = shared.value, []
        for _, _, data, off in tb.runs(column):
            out += [m.score(x) for x in ft.shapes(data, off, len(m.product))]
        p = np.array(out, float)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return add_columns(docs, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)
