"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table (quality, toxic) gives each document posteriors over three domains: ``clean``,
``toxic`` and ``low`` (low quality). With t_i tokens and posteriors p_i, the nonnegative document rates r minimise

    |sum_i r_i t_i p_i - G|^2 / (2 T^2) + (ridge / 2) sum_i (t_i / T) (r_i - 1)^2,      T = sum_i t_i, G = targets * T

by projected gradient in the metric of the documents' token shares, r <- max(0, r - step (p . residual + ridge (r - 1))).
A round needs the K totals sum_i r_i t_i p_i alone: one distributed sum over a narrow table. A small ridge makes a plain
start take thousands of rounds, so the rounds start at the dual's root: at the minimum r_i = max(0, 1 - p_i . residual /
ridge), K equations for the residual, solved by Newton's method, of which each turn is one distributed sum as well. The
rounds go on until the projected gradient (its length in the metric) is below ``TOLERANCE``: what they end at is the minimum,
whatever they started from. ``Fit`` says whether they did, the totals reached and which targets can't be met.

Rates aren't stored between rounds: a rate is a function of its posterior, the start and the residuals of the rounds so far,
replayed in place, so a lost executor costs nothing but a re-read.

``resample`` turns rates into rows: floor(r) copies and one more with the chance of the fraction, drawn from a hash of the
id, so that expected totals are those of the rates.

Defined results: null and empty texts have 0 tokens, their rate follows their posterior and moves no total; repeated rows
have equal rates; without labels of two domains the posteriors are the labels' shares (or equal), and no rate can steer;
an empty table gives no rows; targets must be nonnegative with a positive sum (ValueError) and are scaled to sum 1; targets
out of reach are fitted as nearly as nonnegative rates can and named in ``Fit.missed``; columns named like the results are
replaced, others don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import features as ft
from lexloom.llm import textbytes as tb
from lexloom.llm.store import add_columns, materialize, quoted

DOMAINS = ("clean", "toxic", "low")
#: Wanted shares of the tokens.
TARGETS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
RIDGE = 1e-5
#: Most rounds, and the length of the projected gradient at which they end; a fit that doesn't get there says so.
ROUNDS = 60
TOLERANCE = 1e-9
#: A domain's share of the tokens that is farther than this from its target is missed.
MISSED = 0.005
SLOTS = 1 << 18
ROWS_PER_DOMAIN = 1200


@dataclass
class Softmax:
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[x].sum(axis=0) / np.sqrt(max(1, len(x))) for x in rows]).reshape(len(rows), -1) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _rows(data: np.ndarray, off: np.ndarray, slots: int) -> list[np.ndarray]:
    """Shape grams in the lower half of the slots, terms in the upper one."""
    half = slots // 2
    return [np.concatenate([a, b + half]) for a, b in zip(ft.shapes(data, off, half), ft.terms(data, off, half), strict=True)]


def fit_posteriors(samples: list[tuple[str, int]], shares: np.ndarray, slots: int = SLOTS, rounds: int = 8, rate: float = 0.5, seed: int = 5) -> Softmax:
    """Multinomial logistic regression by Adagrad on a bounded sample; the bias is set to the domains' true shares.

    Only slots whose presence differs between domains beyond chance take part, as in the toxicity model.
    """
    k = len(shares)
    y = np.array([label for _, label in samples], np.int64)
    if len(set(y.tolist())) < 2:
        return Softmax(np.zeros((slots, k), np.float32), np.log(shares))
    rows = []
    for text, _ in samples:
        data = np.frombuffer((text or "").encode(), np.uint8)
        rows += _rows(data, np.array([0, len(data)], np.int64), slots)
    count = np.zeros((slots, k))
    for x, label in zip(rows, y, strict=True):
        count[x, label] += 1
    n = np.bincount(y, minlength=k).astype(float)
    expected = np.outer(count.sum(axis=1), n / n.sum())
    chi = np.where(expected > 0, (count - expected) ** 2 / np.maximum(expected, 1e-9), 0).sum(axis=1)
    useful = (count.sum(axis=1) >= 3) & (chi > 18)
    w, g = np.zeros((slots, k)), np.full((slots, k), 1e-6)
    bias = np.zeros(k)
    weight = n.sum() / (k * np.maximum(n, 1))
    kept = [x[useful[x]] for x in rows]
    scale = [1 / np.sqrt(max(1, len(x))) for x in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            x, s = kept[i], scale[i]
            z = w[x].sum(axis=0) * s + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            d = p * weight[y[i]]
            bias -= 0.02 * d
            if len(x):
                step = d * s + 1e-4 * w[x]
                g[x] += step * step
                w[x] -= rate * step / np.sqrt(g[x])
    return Softmax(w.astype(np.float32), bias + np.log(np.maximum(shares, 1e-6) * k))


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and the place of its domain; rows with a null label are left out."""
    place = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    return labels.select("doc_id", place.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def train(docs: DataFrame, labels: DataFrame, rows_per_domain: int = ROWS_PER_DOMAIN) -> Softmax:
    from lexloom.llm.store import labelled_sample

    named = domain_of(labels)
    n = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
    shares = np.array([n.get(k, 0) + 1 for k in range(len(DOMAINS))], float)
    return fit_posteriors(labelled_sample(docs, named, "domain", F.lit(True), rows_per_domain, tuple(range(len(DOMAINS)))), shares / shares.sum())


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """docs with n_tokens (words) and p_clean, p_toxic, p_low."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)]

    def work(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
        for _, _, data, off in tb.runs(column):
            n.append(np.diff(tb.spans(data, off, tb.NOT_SPACE)[2]))
            p.append(m.posterior(_rows(data, off, len(m.weights))))
        p = np.concatenate(p)
        return [pa.array(np.concatenate(n), pa.int64()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(DOMAINS)))]

    return add_columns(docs, "text", fields, work)


@dataclass
class Fit:
    """The rounds of a solution and what it reaches; a document's rate is ``rate`` of its posterior."""

    start: np.ndarray
    residuals: list[np.ndarray]
    step: float
    ridge: float
    totals: dict[str, float]
    targets: dict[str, float]
    length: float
    converged: bool

    def rate(self, p: np.ndarray) -> np.ndarray:
        r = np.maximum(0, 1 - p @ self.start / self.ridge)
        for residual in self.residuals:
            r = np.maximum(0, r - self.step * (p @ residual + self.ridge * (r - 1)))
        return r

    @property
    def missed(self) -> dict[str, float]:
        """Domains whose share misses the target, with by how much."""
        return {d: self.totals[d] - t for d, t in self.targets.items() if abs(self.totals.get(d, t) - t) > MISSED}


def _sums(table: DataFrame, work, width: int) -> np.ndarray:
    """The sum over the whole table of work(n_tokens, posteriors), an array of ``width``; a row a task is shuffled."""
    columns = [f"p_{d}" for d in DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for b in batches:
            out += work(b.column(0).to_numpy().astype(float), np.column_stack([b.column(i + 1).to_numpy() for i in range(len(columns))]))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"x{i}" for i in range(width)])

    got = table.select("n_tokens", *columns).mapInArrow(run, ", ".join(f"x{i} double" for i in range(width)))
    return np.array([x or 0.0 for x in got.agg(*[F.sum(f"x{i}") for i in range(width)]).first()])


def solve(table: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS, ridge: float = RIDGE) -> Fit:
    """The fit of table (n_tokens, p_...) to targets."""
    k = len(DOMAINS)
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS], float)
    if (goal < 0).any() or not goal.sum():
        raise ValueError(f"targets must be nonnegative with a positive sum, not {targets}")
    goal /= goal.sum()
    wanted = dict(zip(DOMAINS, goal.tolist(), strict=True))

    def moments(residual: np.ndarray):
        """Tokens, totals, second moments of the documents with a positive rate, and their squared rates."""

        def work(t, p):
            r = np.maximum(0, 1 - p @ residual / ridge)
            return np.concatenate([[t.sum()], (r * t) @ p, ((t * (r > 0))[:, None] * p).T.dot(p).ravel(), [(t * r * r).sum()]])

        return work

    def height(residual: np.ndarray) -> float:
        """The convex function whose slope vanishes at the dual's root."""
        return ridge * got[-1] / total / 2 + float(goal @ residual + residual @ residual / 2)

    width = 2 + k + k * k
    start = np.zeros(k)
    got = _sums(table, moments(start), width)
    total = got[0]
    if not total:
        return Fit(start, [], 1.0, ridge, {}, wanted, 0.0, True)
    h = got[1 + k : -1].reshape(k, k) / total
    step = 1 / (np.linalg.eigvalsh(h).max() + ridge)
    low = height(start)
    for _ in range(rounds):
        gap = got[1 : 1 + k] / total - goal - start
        if np.linalg.norm(gap) < TOLERANCE / 10:
            break
        turn, part = np.linalg.solve(got[1 + k : -1].reshape(k, k) / total / ridge + np.eye(k), gap), 1.0
        while True:
            got = _sums(table, moments(start + part * turn), width)
            if height(start + part * turn) <= low - 1e-4 * part * float(gap @ turn) or part < 1e-4:
                break
            part /= 2
        start = start + part * turn
        low = height(start)
    fit = Fit(start, [], step, ridge, {}, wanted, np.inf, False)

    def round_of(residual: np.ndarray | None):
        """Totals, and the squared length of the last step, after the rounds so far (and one of this residual)."""
        before, after = fit, fit if residual is None else Fit(start, [*fit.residuals, residual], step, ridge, {}, wanted, 0.0, False)

        def work(t, p):
            r = after.rate(p)
            return np.append((r * t) @ p, (t * (r - before.rate(p)) ** 2).sum())

        return after, work

    made = _sums(table, round_of(None)[1], k + 1)
    for _ in range(rounds):
        after, work = round_of(made[:k] / total - goal)
        made = _sums(table, work, k + 1)
        fit = after
        fit.length = float(np.sqrt(made[k] / total) / step)
        if fit.length < TOLERANCE:
            fit.converged = True
            break
    fit.totals = dict(zip(DOMAINS, (made[:k] / total).tolist(), strict=True))
    return fit


def with_rates(table: DataFrame, fit: Fit) -> DataFrame:
    """table with the column ``rate``."""
    columns = [f"p_{d}" for d in DOMAINS]
    names = [c for c in table.columns if c != "rate"]
    kept = table.select(*[quoted(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.column_stack([b.column(names.index(c)).to_numpy() for c in columns])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fit.rate(p))], names=[*names, "rate"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("rate", T.DoubleType())]))


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[DataFrame, Fit]:
    """(doc_id, n_tokens, p_clean, p_toxic, p_low, rate), and the fit: totals reached, targets missed, convergence."""
    table = materialize(posteriors(docs.select("doc_id", "text"), train(docs, labels)).drop("text"))
    fit = solve(table, targets)
    return with_rates(table, fit), fit


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rates of ``fit_rates`` with, on each row, whether the fit converged and the share of a domain farthest from its
    target (signed)."""
    rates, fit = fit_rates(docs, labels, targets)
    farthest = max((fit.totals[d] - t for d, t in fit.targets.items() if d in fit.totals), key=abs, default=0.0)
    return rates.withColumn("converged", F.lit(fit.converged)).withColumn("farthest", F.lit(float(farthest)))


def copies(rate, doc_id):
    """How often a row of this rate is drawn: floor(rate), and one more by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("mix"), doc_id.cast("string")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs with each row as often as its rate draws it, in docs' own columns."""
    table = fit_rates(docs, labels, targets)[0].select("doc_id", "rate").where("doc_id is not null")
    drawn = table.groupBy("doc_id").agg(F.max("rate").alias("_rate")).select("doc_id", copies(F.col("_rate"), F.col("doc_id")).alias("_copies"))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "doc_id")
    both = rows.join(drawn, "doc_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1))).where("_copies > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
