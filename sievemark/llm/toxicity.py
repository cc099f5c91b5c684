"""Toxicity: a factorization machine over hashed terms.

Model: ``y(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` with x_i = 1 where hashed term i is in the document.
The pairwise part learns what single terms don't tell, such as an insult beside the mention of a group.
The two classes have the same weight in the fit, so 0.5 is where the evidence for either is equal.
Fitting uses at most ``SAMPLE`` labelled documents (collected as term ids); scoring covers every document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import Memo, chunks, flatten, hashed, labelled_sample, table

#: Labelled documents used for fitting, at most.
SAMPLE = 8000
BITS = 20
TERMS = 4096
FACTORS = 4
THRESHOLD = 0.5
FALSE_COST = 20.0
#: Penalties of the factors to choose from; under the last they vanish where pairs of terms tell nothing.
PENALTIES = (5e-4, 2e-2, 1.0)


@dataclass
class Machine:
    """slot: hashed term -> row of w and v."""

    slot: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray
    bits: int = BITS

    def logits(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """rows, slots: the distinct (document, slot) pairs of n documents."""
        out = self.bias + np.bincount(rows, self.w[slots], n)
        for f in range(self.v.shape[1]):
            x = self.v[slots, f]
            out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out


def pairs(texts, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs with a value of 0 or more."""
    ids, sizes = flatten(texts, memo)
    rows = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
    both = np.unique((rows << 32) | ids[ids >= 0])
    return both >> 32, both & 0xFFFFFFFF


def _terms(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(lambda t: hashed(t, bits))
        for b in batches:
            rows, ids = pairs(b["text"], memo)
            cut = np.searchsorted(rows, np.arange(1, len(b)))
            yield pd.DataFrame({"y": b["y"], "terms": np.split(ids.astype(np.int32), cut) if len(b) else []})

    return run


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int, steps: int = 120, l2: float = 2e-3, l2v: float = 5e-3, seed: int = 7):
    """Full-batch Adam on the weighted logistic loss. x: documents x terms, of 0 and 1."""
    n, p = x.shape
    rng = np.random.default_rng(seed)
    w, v = np.zeros(p, np.float32), rng.normal(0, 0.02, (p, factors)).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    rate = float(np.clip((weight * y).sum(), 1e-4, 1 - 1e-4))
    bias = float(np.log(rate / (1 - rate)))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    for step in range(1, steps + 1):
        s = x @ v
        z = bias + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        xg = g @ x
        grads = xg + l2 * w, x.T @ (g[:, None] * s) - xg[:, None] * v + l2v * v, float(g.sum())
        for k, (value, grad) in enumerate(zip((w, v, bias), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * grad * grad
            move = 0.05 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
            if k == 2:
                bias = value - float(move)
            else:
                value -= move.astype(np.float32)
    return bias, w, v


def screen(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Term ids to model: half by association with the label, half by document frequency, of those in 4 documents or more."""
    ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    sizes = np.array([len(r) for r in rows])
    terms, inverse, df = np.unique(ids, return_inverse=True, return_counts=True)
    pos = np.bincount(inverse, np.repeat(y, sizes), len(terms))
    ok = df >= 4
    rate = y.mean() if len(y) else 0.0
    z = np.abs(pos - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9))
    by_z = np.argsort(-np.where(ok, z, -1), kind="stable")[: most // 2]
    by_df = np.argsort(-np.where(ok, df, -1), kind="stable")[: most // 2]
    chosen = np.union1d(by_z, by_df)
    return terms[chosen[ok[chosen]]]


def logits(x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    s = x @ v
    return bias + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))


def crossed(x: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int, l2v: float) -> np.ndarray | None:
    """Logits of documents that the fit hasn't seen: two halves score each other. None where a half has one class only."""
    first = slice(0, -(-len(y) // 2))  # slices, so that nothing is copied
    second = slice(first.stop, len(y))
    z = np.zeros(len(y))
    for own, other in ((first, second), (second, first)):
        if len(set(y[own].tolist())) < 2:
            return None
        z[other] = logits(x[other], *train(x[own], y[own], weight[own], factors, l2v=l2v))
    return z


def chosen(x: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int, penalties: tuple[float, ...]) -> tuple[float, float]:
    """(penalty of the factors, cut): the penalty of the least loss over documents that the fit hasn't seen, so that factors are
    as strong as pairs of terms tell more than the terms alone; and the logit at which such documents are told apart best, where
    a clean document's loss counts FALSE_COST times a toxic one's escape."""
    best = None
    for l2v in penalties:
        z = crossed(x, y, weight, factors, l2v)
        if z is None:
            return penalties[-1], 0.0
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
        if best is None or loss < best[0]:
            best = loss, l2v, z
    _, l2v, z = best
    options = np.quantile(z, np.linspace(0, 1, 801))
    options = np.unique(np.concatenate([options, (options[1:] + options[:-1]) / 2]))
    gain = [(z[y == 1] > t).mean() - FALSE_COST * (z[y == 0] > t).mean() for t in options]
    top = np.flatnonzero(np.isclose(gain, max(gain)))
    return l2v, float((options[top[0]] + options[top[-1]]) / 2) if np.all(np.diff(top) == 1) else float(options[top[len(top) // 2]])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, bits: int = BITS, terms: int = TERMS, factors: int = FACTORS, penalties: tuple[float, ...] = PENALTIES) -> Machine | None:
    """None where the labels don't have both classes."""
    rows, weights = labelled_sample(docs, labels.filter(F.col(target).isin(0, 1)), target, sample)
    if len(weights) < 2:
        return None
    got = rows.mapInPandas(_terms(bits), "y double, terms array<int>").toArrow().combine_chunks()
    ys = got["y"].to_numpy()
    if len(set(ys.tolist())) < 2:
        return None
    terms_of = got["terms"].combine_chunks()
    values, at = terms_of.flatten().to_numpy(), np.concatenate([[0], np.cumsum(terms_of.value_lengths().to_numpy())])
    order = sorted(range(len(ys)), key=lambda k: (ys[k], values[at[k] : at[k + 1]].tobytes()))  # the same on any layout
    order = order[::2] + order[1::2]  # either half has its share of both classes
    y, lists = ys[order].astype(np.float32), [values[at[k] : at[k + 1]] for k in order]
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))  # both classes count the same
    keep = screen(lists, y, weight, terms)
    x = np.zeros((len(y), len(keep)), np.float32)
    for i, t in enumerate(lists):
        at = np.searchsorted(keep, t)
        at[at == len(keep)] = 0
        x[i, at[keep[at] == t] if len(keep) else []] = 1
    l2v, cut = chosen(x, y, weight, factors, penalties)
    bias, w, v = train(x, y, weight, factors, l2v=l2v)
    bias -= cut
    return Machine({int(t): i for i, t in enumerate(keep)}, bias, w.astype(np.float64), v.astype(np.float64), bits)


def probability(spark: SparkSession, model: Machine | None):
    """Column function text -> probability. Null and empty texts have the bias's probability; without a model, all are 0."""
    shared = spark.sparkContext.broadcast(model)  # TERMS rows at most, whatever the corpus

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        memo = Memo(lambda t: m.slot.get(hashed(t, m.bits), -1))
        for texts in batches:
            out = np.zeros(len(texts))
            if m is not None:
                for a, b in chunks(len(texts), 256):
                    rows, slots = pairs(texts.iloc[a:b], memo)
                    out[a:b] = 1 / (1 + np.exp(-np.clip(m.logits(rows, slots, b - a), -30, 30)))
            yield pd.Series(out)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of ``docs``, in which only doc_id and text are read.

    Null or empty text: scored by the bias alone. Null doc_id: scored, not used for fitting. Repeated rows: a row each, of the
    same score. Empty documents: no rows. Labels of one class or none: no model, toxicity 0. Other columns are ignored.
    """
    score = probability(docs.sparkSession, fit(docs, labels, **options))
    return docs.select("doc_id", score(F.col("text").cast("string")).alias("toxicity")).select("doc_id", "toxicity", (F.col("toxicity") >= threshold).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose toxicity is below the threshold."""
    score = probability(docs.sparkSession, fit(docs, labels, **options))
    return docs.filter(score(F.col("text").cast("string")) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
