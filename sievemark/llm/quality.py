"""Quality: ordinal cumulative-link regression on graded ratings.

``P(grade > k | x) = sigmoid(f(x) - theta_k)`` with one weight vector for all grades and ordered thresholds theta_0 < theta_1 < ...
The features are the relative frequencies of hashed words and of hashed word shapes (letters, capitals and digits each
collapsed), and the share of tokens that repeat the one before, so f(x) is a mean over the text's tokens. Fitting uses at most ``SAMPLE`` rated documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import Memo, crc, labelled_sample, normal, table

#: Rated documents used for fitting, at most.
SAMPLE = 4000
BITS = 18
TERMS = 3072
TAIL = 0.5
REPEAT = -1
_SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), lambda m: "0"))


def shape(token: str) -> str:
    for pattern, to in _SHAPE:
        token = pattern.sub(to, token)
    return token


def features(token: str, bits: int = BITS) -> tuple[int, int]:
    """Buckets of the word and of its shape; the highest bit tells them apart."""
    mask = (1 << bits) - 1
    return crc(normal(token)) & mask, (crc(shape(token), 1) & mask) | (1 << bits)


def repeats(tokens: list[str]) -> float:
    """Share of the tokens that equal the one before."""
    return sum(map(eq, tokens, tokens[1:])) / max(1, len(tokens))


@dataclass
class Ordinal:
    """grades: rising; theta: one fewer. weight: feature -> its weight."""

    grades: list[float]
    theta: np.ndarray
    weight: dict[int, float]
    bits: int = BITS

    def token(self, raw: str) -> float:
        return sum(self.weight.get(f, 0.0) for f in features(raw, self.bits))

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.theta[None, :], -30, 30)))


def _counts(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(lambda t: features(t, bits))
        for b in batches:
            ids, values = [], []
            for text in b["text"]:
                tokens = text.split() if text else []
                k, n = np.unique(np.array([f for t in tokens for f in memo[t]], np.int32), return_counts=True)
                ids.append(np.concatenate([[REPEAT], k]).astype(np.int32))
                values.append(np.concatenate([[repeats(tokens)], n / max(1, len(tokens))]).astype(np.float32))
            yield pd.DataFrame({"y": b["y"], "ids": ids, "x": values})

    return run


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, levels: int, steps: int = 250, l2: float = 1e-4):
    """Weighted maximum likelihood by Adam. y: 0 .. levels-1. Returns (weights, ordered thresholds)."""
    weight = weight / weight.sum()
    above = np.array([(weight * (y > k)).sum() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    params = [np.zeros(x.shape[1]), np.concatenate([theta[:1], gaps])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def ordered(raw):
        return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])

    for step in range(1, steps + 1):
        f, t = x @ params[0].astype(x.dtype), ordered(params[1])
        cum = 1 / (1 + np.exp(-np.clip(f[:, None] - t[None, :], -30, 30)))  # P(y > k)
        edge = np.concatenate([np.ones((len(y), 1)), cum, np.zeros((len(y), 1))], 1)
        slope = edge * (1 - edge)
        at = np.arange(len(y))
        p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-9)
        df = -weight * (slope[at, y] - slope[at, y + 1]) / p
        dt = np.zeros(levels - 1)
        for k in range(levels - 1):  # theta_k is the lower edge of grade k+1 and the upper edge of grade k
            dt[k] = (weight * slope[:, k + 1] * ((y == k + 1) * 1.0 - (y == k)) / p).sum()
        raw = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(params[1][k]) for k in range(1, levels - 1)]])
        for k, g in enumerate(((df.astype(x.dtype) @ x).astype(float) + l2 * params[0], raw)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return params[0], ordered(params[1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, bits: int = BITS, terms: int = TERMS) -> Ordinal | None:
    """None where the ratings have fewer than two grades."""
    rows, weights = labelled_sample(docs, labels, target, sample)
    if len(weights) < 2:
        return None
    got = rows.mapInPandas(_counts(bits), "y double, ids array<int>, x array<float>").toPandas()
    grades = sorted(float(g) for g in got["y"].unique())
    if len(grades) < 2:
        return None
    found = ((float(y), np.asarray(i, np.int32), np.asarray(x, np.float32)) for y, i, x in zip(got["y"], got["ids"], got["x"], strict=True))
    found = sorted(found, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # the same order on any layout
    y = np.searchsorted(grades, [r[0] for r in found])
    weight = np.array([weights[grades[k]] for k in y])
    ids = np.concatenate([r[1] for r in found])
    names, df = np.unique(ids, return_counts=True)
    keep = np.sort(names[np.argsort(-df, kind="stable")][: int((df >= 4).sum())][:terms])
    x = np.zeros((len(y), len(keep)), np.float32)
    for i, (_, t, v) in enumerate(found):
        at = np.searchsorted(keep, t)
        at[at == len(keep)] = 0
        hit = keep[at] == t if len(keep) else np.zeros(len(t), bool)
        x[i, at[hit]] = v[hit]
    w, theta = train(x, y, weight, len(grades))
    return Ordinal(grades, theta, {int(k): float(v) for k, v in zip(keep, w, strict=True)}, bits)


def grade(docs: DataFrame, labels: DataFrame, at_least: float | None = None, tail: float = TAIL, **options) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) for every row of ``docs``; keep is tail_probability >= ``tail``.

    tail_probability is P(grade >= at_least), by default of the second lowest grade. Null or empty text: f(x) = 0, so the
    thresholds alone decide. Null doc_id: graded, not used for fitting. Repeated rows: a row each. Empty documents: no rows.
    Fractional grades are grades of their own, more than MOST_GRADES distinct ones an error. Fewer than two grades: no model; expected_grade is null, tail_probability 1, keep true. Other columns are ignored.
    """
    spark, model = docs.sparkSession, fit(docs, labels, **options)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(model)  # TERMS weights at most, whatever the corpus
    level = max(1, int(np.searchsorted(model.grades, model.grades[1] if at_least is None else at_least)))

    @F.pandas_udf("expected double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        memo = Memo(m.token)
        get, steps, again = memo.__getitem__, np.diff(m.grades), m.weight.get(REPEAT, 0.0)
        for texts in batches:
            f = np.zeros(len(texts))
            for i, text in enumerate(texts):
                if text and (tokens := text.split()):
                    f[i] = sum(map(get, tokens)) / len(tokens) + again * repeats(tokens)
            p = m.tails(f)
            yield pd.DataFrame({"expected": m.grades[0] + p @ steps, "tail": p[:, level - 1] if level <= p.shape[1] else np.zeros(len(f))})

    got = docs.select("doc_id", score(F.col("text").cast("string")).alias("s"))
    return got.select("doc_id", F.col("s.expected").alias("expected_grade"), F.col("s.tail").alias("tail_probability"), (F.col("s.tail") >= tail).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
