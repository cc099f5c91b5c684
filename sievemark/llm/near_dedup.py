"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Every word 3-gram of a text is hashed once; the hash picks a bin and competes for its minimum. Empty bins borrow from a bin
chosen by a universal hash of (bin, attempt). BANDS bands of ROWS bins are bucket keys; in a bucket each document is
linked with the bucket's least doc_id only, so a bucket of n documents has n - 1 edges. Edges whose signatures agree are
checked by the exact Jaccard similarity of the 3-gram sets. Where an edge of a bucket doesn't hold, the bucket's documents may
still be near copies of one another: all its pairs that aren't connected yet are compared by signature, and those that agree
are checked too. So every two documents of a bucket are compared or connected. Connected components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import bloom
from sievemark.llm.common import Memo, chunks, crc, flatten, materialise, normal, table

THRESHOLD = 0.5
BANDS, ROWS = 32, 3
BINS = BANDS * ROWS
#: Signatures of this much less than the threshold are not checked in full: over three standard errors of a 96-bin estimate.
MARGIN = 0.17
#: Documents of a bucket that a task compares with as many others at once; a larger bucket is parted among tasks.
BLOCK = 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_EMPTY = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: DONORS[j, i]: the bin that empty bin i asks at attempt j.
DONORS = (_mix(np.arange(16 * BINS * BINS, dtype=np.uint64) + np.uint64(12345)) % np.uint64(BINS)).astype(np.int64).reshape(-1, BINS)


def token_hash(raw: str) -> int:
    word = normal(raw)
    return crc(word) if word else -1


def shingles(texts, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word 3-gram, with repeats; a text of one or two words has one shingle, one without words none."""
    ids, sizes = flatten(texts, memo)
    rows = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
    ids = ids[ids >= 0].astype(np.uint64)
    n = np.bincount(rows, minlength=len(sizes))
    ends = np.cumsum(n)
    pad = np.concatenate([ids, np.zeros(2, np.uint64)])
    left = np.repeat(ends, n) - np.arange(len(ids))  # words from here to the text's end
    second, third = np.where(left > 1, pad[1:-1], 0), np.where(left > 2, pad[2:], 0)
    h = _mix(ids * _ODD[0] + second.astype(np.uint64) * _ODD[1] + third.astype(np.uint64) * _ODD[2])
    keep = (left > 2) | (np.arange(len(ids)) == np.repeat(ends - n, n))  # full 3-grams, or the start of a text
    return rows[keep], h[keep]


def signatures(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x BINS of uint32, which rows have any shingle)."""
    sig = np.full(n * BINS, _EMPTY, np.uint32)
    at = rows * BINS + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, at, np.minimum((h >> np.uint64(32)).astype(np.uint32), _EMPTY - np.uint32(1)))
    sig = sig.reshape(n, BINS)
    full = sig != _EMPTY
    some = full.any(1)
    r, c = np.nonzero(~full & some[:, None])
    for donors in DONORS:
        if not len(r):
            break
        d = donors[c]
        ok = full[r, d]
        sig[r[ok], c[ok]] = sig[r[ok], d[ok]]
        r, c = r[~ok], c[~ok]
    for i, j in zip(r, c, strict=True):  # still empty after 16 * BINS attempts: the next full bin
        sig[i, j] = sig[i, np.flatnonzero(np.roll(full[i], -j))[0] + j - BINS]
    return sig, some


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.repeat(np.arange(BANDS, dtype=np.uint64)[None] + np.uint64(1), len(sig), 0)
    for k in range(ROWS):
        h = _mix(h * _ODD[0] + parts[:, :, k])
    return h.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = Memo(token_hash)
    for b in batches:
        for lo, hi in chunks(len(b), 512):
            part = b.iloc[lo:hi]
            sig, some = signatures(*shingles(part["text"], memo), len(part))
            sig = sig[some]
            yield pd.DataFrame({"id": part["id"].to_numpy()[some], "bands": list(bands(sig)), "sig": [s.tobytes() for s in sig.astype(np.uint16)]})


def _estimate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, BINS) for s in (a, b))
        yield pd.Series((x == y).mean(1))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = Memo(token_hash)
    hub, mine = None, np.zeros(0, np.uint64)
    for b in batches:
        out = np.zeros(len(b))
        for k, (text, other) in enumerate(zip(b["hub_text"], b["text"], strict=True)):
            if text != hub:
                hub, mine = text, np.unique(shingles([text], memo)[1])
            theirs = np.unique(shingles([other], memo)[1])
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            out[k] = common / max(1, len(mine) + len(theirs) - common)
        yield pd.DataFrame({"hub": b["hub"], "id": b["id"], "jaccard": out})


def _unconnected(threshold: float):
    """Pairs of different root whose signatures agree, in rows sorted by (bucket, i, j): within block i where i = j, else of block i with block j."""

    def within(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, roots, block = (g[c].to_numpy(np.int64) for c in ("id", "root", "block"))
        if (roots == roots[0]).all():
            return
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(-1, BINS)
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for lo, hi in chunks(len(left), max(1, 32_768 // max(1, len(right)))):
            at = left[lo:hi]
            open_ = roots[at][:, None] != roots[right][None]
            if i == j:
                open_ &= at[:, None] < right[None]
            x, y = np.nonzero(open_)
            x, y = at[x], right[y]
            ok = (sig[x] == sig[y]).mean(1) >= threshold - MARGIN
            if ok.any():
                x, y = ids[x[ok]], ids[y[ok]]
                yield pd.DataFrame({"hub": np.minimum(x, y), "id": np.maximum(x, y)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            keys = b[["bucket", "i", "j"]].to_numpy(np.int64)
            starts = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))).tolist()]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                yield from within(b.iloc[lo:hi])
            rest = b.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield from within(rest)

    return run


def pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hub, id, jaccard) of the candidate edges that hold, hub < id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).dropna()
    signed = materialise(texts.mapInPandas(_sign, "id long, bands array<long>, sig binary"), "minhash")
    buckets = signed.select("id", F.explode("bands").alias("bucket"))
    # least ids are combined on the map side, and a join can be split where one bucket holds very many
    hubs_of = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = materialise(buckets.join(hubs_of, "bucket").filter("hub < id").distinct(), "minhash-star")
    mine, hubs = signed.select("id", "sig"), signed.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig"))
    alike = F.pandas_udf(_estimate, "double")

    def verified(edges: DataFrame) -> DataFrame:
        ends = edges.select("id").union(edges.select("hub")).distinct()
        bodies = materialise(bloom.narrowed(texts, ends, ["id"]), "minhash-bodies")
        both = edges.join(bodies, "id").join(bodies.select(F.col("id").alias("hub"), F.col("text").alias("hub_text")), "hub")
        checked = both.mapInPandas(_verify, "hub long, id long, jaccard double").filter(F.col("jaccard") >= threshold)
        return materialise(checked.groupBy("hub", "id").agg(F.max("jaccard").alias("jaccard")), "minhash-verified")

    edges = star.select("hub", "id").distinct().join(mine, "id").join(hubs, "hub").filter(alike("sig", "hub_sig") >= threshold - MARGIN).select("hub", "id").distinct()
    first = verified(materialise(edges, "minhash-edges"))
    # buckets with an edge that doesn't hold and more than one document besides the hub, which is compared with all
    held = star.join(first.select("hub", "id", F.lit(1).alias("held")), ["hub", "id"], "left")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"), F.count("held").alias("held")).filter("n > 1 and held < n").select("bucket", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    members = star.select("bucket", "id").join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = members.join(components(first), "id", "left").withColumn("root", F.coalesce("root", "id"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root").join(mine, "id")
    spread = spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = materialise(spread.mapInPandas(_unconnected(threshold), "hub long, id long").distinct(), "minhash-more")
    return first.union(verified(more))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node but the roots, root the least id of the component, by alternating large and small stars."""
    edges = materialise(edges.select(F.col("hub").alias("a"), F.col("id").alias("b")), "components")

    def star(sym: DataFrame, larger: bool) -> DataFrame:
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        rows = sym.join(low, "u")
        links = rows.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("b > a") if not larger else rows.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not larger:
            links = links.union(rows.select(F.col("m").alias("a"), F.col("u").alias("b")).filter("b > a"))
        return links.distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = mark(edges)
    while True:
        large = star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), True)
        edges = materialise(star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), False), "components")
        now = mark(edges)
        if now == last:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id): a row for every document of a group of near copies but the one of the least doc_id, which stays.

    Two documents are near copies where the Jaccard similarity of their word 3-gram sets (words in lower case, without outer
    punctuation) is ``threshold`` or more; groups are connected components. Null doc_id, null text and texts without words:
    in no group. Rows of one doc_id are one document, whose texts are all compared. Texts of one or two words are near copies
    if their words are equal. Empty table: no rows. Other columns are ignored.
    """
    return components(pairs(docs, threshold)).select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def unique(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, but those of the doc_ids that ``near_duplicates`` names."""
    name = docs.columns[[c.lower() for c in docs.columns].index("doc_id")]
    gone = materialise(near_duplicates(docs, threshold).select(F.col("doc_id").cast(docs.schema[name].dataType).alias(name)), "minhash-gone")
    return bloom.without(docs, gone, [name])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
