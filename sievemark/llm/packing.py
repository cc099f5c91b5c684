"""Packing by non-negative least squares over shallow length combinations.

1. Every document is cut into pieces of WINDOW words at most; Spark counts the pieces of each length (WINDOW rows).
2. All combinations of up to three lengths that sum to WINDOW are enumerated; projected gradient solves
   min || A x - histogram || with x >= 0, where A[l, s] is how often length l is in combination s.
3. x is rounded, never using more pieces than there are; what is left is packed best-fit decreasing by lengths.
4. Pieces take their places by their rank within their length, found with two-level counts instead of one global sort.
Steps 2 and 3 work on the histogram, so their cost and what workers receive depend on WINDOW and not on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import materialise, table

WINDOW = 2048
#: Pieces of one length that a task ranks, about; a frequent length has as many buckets as that takes.
BUCKET_ROWS = 1 << 19
STEPS = 150
#: A run of characters that aren't white space in Unicode's sense.
WORD = r"(?U)\S+"


@lru_cache(maxsize=2)
def combinations(window: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = window; 0 stands for none."""
    b, c = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    a = window - b - c
    ok = (a >= b) & (b >= c) & ((b > 0) | (c == 0))
    return np.stack([a[ok], b[ok], c[ok]], 1)


def solve(histogram: np.ndarray, window: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, x >= 0) by accelerated projected gradient; only combinations of lengths that occur are kept."""
    combos = combinations(window)
    combos = combos[np.all((histogram[combos] > 0) | (combos == 0), axis=1)]
    h = histogram.astype(float).copy()
    h[0] = 0
    if not len(combos):
        return combos, np.zeros(0)
    scale = max(h.max(), 1.0)
    h /= scale
    # Jacobi scaling: each length is shared by the combinations that have it
    degree = np.bincount(combos.ravel(), minlength=window + 1)
    step = 1.0 / (3.0 * degree[combos].max(1))
    x = np.min(np.where(combos > 0, h[combos] / degree[combos], np.inf), axis=1)
    y, t = x.copy(), 1.0
    for _ in range(steps):
        r = np.bincount(combos.ravel(), np.repeat(y, 3), window + 1) - h
        r[0] = 0
        new = np.maximum(0, y - step * r[combos].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return combos, x * scale


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram (index: length, 0 .. window) exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos, x = solve(left, window)
    for k in np.argsort(-x, kind="stable"):
        n = int(round(x[k]))
        if n < 1:
            break
        lengths = tuple(int(v) for v in combos[k] if v)
        for v in set(lengths):
            n = min(n, int(left[v]) // lengths.count(v))
        if n:
            for v in lengths:
                left[v] -= n
            out.append((lengths, n))
    # what is left: best-fit decreasing, on counts
    room: dict[int, list[list]] = {}
    done: list[list] = []
    for v in range(window, 0, -1):
        n = int(left[v])
        fresh: list[tuple[int, list]] = []
        while n:
            fits = min((s for s in room if s >= v), default=None)
            if fits is None:
                k = min(n, max(1, n // (window // v)))
                take = [(v,), k]
                n -= k
                space = window - v
            else:
                entry = room[fits][-1]
                k = min(n, entry[1])
                entry[1] -= k
                if not entry[1]:
                    room[fits].pop()
                    if not room[fits]:
                        del room[fits]
                take = [(*entry[0], v), k]
                n -= k
                space = fits - v
            fresh.append((space, take))
            if space:
                room.setdefault(space, []).append(take)
            else:
                done.append(take)
    left_over = done + [e for s in sorted(room) for e in room[s]]
    merged: dict[tuple, int] = {}
    for lengths, n in left_over:
        merged[lengths] = merged.get(lengths, 0) + n
    return out + sorted((k, n) for k, n in merged.items() if n)


def segments(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first pack, offset in the pack), one entry for each run of packs; rising ranks."""
    rank: dict[int, int] = {}
    runs: dict[int, list] = {}
    pack = 0
    for lengths, n in steps:
        offset = 0
        for v in lengths:
            runs.setdefault(v, []).append((rank.get(v, 0), pack, offset))
            rank[v] = rank.get(v, 0) + n
            offset += v
        pack += n
    return {v: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for v, r in runs.items()}


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, length, pack_id, position): where each piece of each document goes; no pack holds more than ``window`` words.

    A document of n words has ceil(n / window) pieces, all but the last of them full. Words are runs of characters other than Unicode white space.
    Null, empty and blank texts have no words and no rows. Null doc_ids and repeated rows are packed like any other; equal
    (length, doc_id, piece) take their places in any order, so the set of rows is the same. Empty table: no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    words = F.regexp_count(text, F.lit(WORD))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.cast("long").alias("n")).filter("n > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {window}")))
    pieces = counted.select("doc_id", "n", piece.alias("piece")).select("doc_id", "piece", F.least(F.lit(window).cast("long"), F.expr(f"n - piece * {window}")).alias("length"))
    pieces = materialise(pieces, "packing")
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("k")).collect():  # window rows at most
        histogram[r["length"]] = r["k"]
    # within a length, rows of one bucket are counted and ranked apart, so that a frequent length isn't one task's work
    buckets = F.get(F.array(*[F.lit(int(-(-k // BUCKET_ROWS) or 1)) for k in histogram]), F.col("length").cast("int"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)  # a row for each length and for each BUCKET_ROWS pieces
    shared = spark.sparkContext.broadcast(segments(plan(histogram, window)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            packs, at = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, cut = np.unique(length[order], return_index=True)
            for v, rows in zip(kinds.tolist(), np.split(order, cut[1:]), strict=True):
                first, base, offset = runs[v]
                k = np.searchsorted(first, rank[rows], "right") - 1
                packs[rows] = base[k] + rank[rows] - first[k]
                at[rows] = offset[k]
            yield pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in b["doc_id"]], "Int64"), "piece": b["piece"], "length": length, "pack_id": packs, "position": at})

    # ids travel as text, since pandas would make a column with nulls doubles
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("nth", nth).join(counts.select("length", "bucket", "before"), ["length", "bucket"])
    return ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "length", (F.col("before") + F.col("nth") - 1).alias("rank")).mapInPandas(place, "doc_id long, piece long, length long, pack_id long, position long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
