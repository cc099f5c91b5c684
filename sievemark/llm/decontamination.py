"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the idf.
2. The benchmark's passages (items, long ones cut) are TF-IDF rows in blocks of BLOCK; a randomised SVD of each block, whose
   products run over the distributed passages, gives a latent space of RANK dimensions, half of a block's passages, and each
   passage's place in it. A passage that keeps less than KEPT of its energy there adds its residual to the basis: it is then
   searched by its exact TF-IDF cosine, so no passage is lost however large the benchmark is.
3. Every window of WINDOW words, a new one each STRIDE words, of every document is folded into that space; its inner product
   with a passage's place, over the energy that the passage keeps, estimates their cosine. Passages that reach COSINE (less for
   those that couldn't in a window that holds them verbatim) are candidates. A bound (the sum over the window's words of the most that any
   passage gives the word) tells which windows can reach it; the others aren't folded.
4. A candidate is a leak where the longest common subsequence of words covers VERBATIM of the passage, or PARAPHRASE of it
   together with ANSWER of the item's answer (its text after an answer mark, else its last sentence).
Items of fewer than MIN_WORDS words leave too little for a cosine and are looked up as exact sequences of words.
No step shuffles text: frequencies are summed in fixed chunks, candidates are verified where they are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import Memo, chunks, flatten, hashing, materialise, normal, table

BITS = 18
WINDOW, STRIDE = 48, 16
#: Passages that share a latent space, and its dimensions.
BLOCK, RANK = 256, 128
KEPT = 0.25
#: Least cosine of a candidate; or SLACK of the cosine that a verbatim passage has in a window whose other words weigh SURE times
#: as much as words do on average, if that is less: so that short items, and those of common words, are found.
COSINE, SLACK, SURE = 0.4, 0.9, 2.0
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
#: Shorter items are looked up word by word.
MIN_WORDS = 8
#: Passages searched in one pass over the documents; a larger benchmark takes more passes.
AT_ONCE = 4096
_ANSWER_MARK = re.compile(r"(?:^|\s)(?:answer|a)\s*:\s*", re.I)
_PART = 4096
#: Sums of one chunk that are formed beside each other before the last.
_SLOTS = 256


def _sum_chunks(parts: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Sum of (chunk, binary array) rows by chunk, in two levels, each streamed, so that no task holds all tasks' arrays."""
    name = np.dtype(kind).name

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, total = None, None
        for b in batches:
            for chunk, part in b[["chunk", "part"]].itertuples(index=False):
                got = np.frombuffer(part, name)
                total = got.copy() if total is None else total + got
        yield pd.DataFrame({"chunk": [chunk], "part": [total.tobytes()]})

    some = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(_SLOTS))).groupBy("chunk", "slot").applyInPandas(add, "chunk int, part binary")
    got = some.groupBy("chunk").applyInPandas(add, "chunk int, part binary").toPandas()
    return {int(c): np.frombuffer(p, name) for c, p in zip(got["chunk"], got["part"], strict=True)}


def inverse_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(idf of each bucket, mean squared idf of the words that documents have) over all rows of ``texts`` (column text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, df, seen = hashing(bits), np.zeros(1 << bits, np.int64), 0
        for b in batches:
            seen += len(b)
            for lo, hi in chunks(len(b), 512):
                ids, sizes = flatten(b["text"].iloc[lo:hi], memo)
                both = np.sort(((np.repeat(np.arange(len(sizes)), sizes) << bits) | ids)[ids >= 0])
                first = np.ones(len(both), bool)
                first[1:] = both[1:] != both[:-1]
                df += np.bincount(both[first] & ((1 << bits) - 1), minlength=1 << bits)
        if seen:
            n = -(-len(df) // _PART)
            yield pd.DataFrame({"chunk": [*range(n), -1], "part": [*(df[k * _PART : (k + 1) * _PART].tobytes() for k in range(n)), np.array([seen]).tobytes()]})

    got = _sum_chunks(texts.mapInPandas(count, "chunk int, part binary"), np.int64)
    seen = int(got.pop(-1, np.zeros(1))[0])
    df = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(1 << bits)
    idf = np.log((1 + seen) / (1 + df)) + 0.1
    return idf, float((df * idf**2).sum() / max(1, df.sum()))


def least_estimate(ids: np.ndarray, idf: np.ndarray, usual: float, cosine: float) -> float:
    """The estimate at which a passage is a candidate."""
    words, tf = np.unique(ids, return_counts=True)
    own = (tf * idf[words] ** 2).sum()
    verbatim = np.linalg.norm(tf * idf[words]) / np.sqrt(own + max(0, WINDOW - len(ids)) * SURE * usual)
    return float(min(cosine, SLACK * verbatim))


def answer_of(text: str) -> str:
    parts = _ANSWER_MARK.split(text)
    if len(parts) > 1:
        return parts[-1]
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s][-1:][0] if text.strip() else ""


def passages(item_id, text: str, bits: int = BITS) -> list[tuple]:
    """(item_id, word buckets, answer's word buckets or none, words of an item of fewer than MIN_WORDS) of an item cut into pieces of WINDOW words."""
    memo = hashing(bits)
    ids = flatten([text], memo)[0]
    ids = ids[ids >= 0]
    if len(ids) < MIN_WORDS:
        return [(item_id, ids, ids[:0], [w for w in map(normal, text.split()) if w])] if len(ids) else []
    cuts = list(range(WINDOW, len(ids), WINDOW))
    if cuts and len(ids) - cuts[-1] < MIN_WORDS:
        cuts.pop()
    answer = flatten([answer_of(text)], memo)[0]
    pieces = np.split(ids, cuts)
    return [(item_id, p, answer[answer >= 0] if k == len(pieces) - 1 else answer[:0], []) for k, p in enumerate(pieces)]


def common_length(needle: np.ndarray, hay: np.ndarray) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(needle.tolist()):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(needle)) - 1
    v = full
    for x in hay.tolist():
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(needle) - v.bit_count()


@dataclass
class Index:
    """Of one block. idf by bucket; slot: row of ``basis`` of a bucket, or -1; place: each passage in the latent space, over the
    energy it keeps there; least: the estimate at which a passage is a candidate."""

    idf: np.ndarray
    slot: np.ndarray
    basis: np.ndarray
    place: np.ndarray
    least: np.ndarray
    items: list = field(default_factory=list)
    most: np.ndarray = field(init=False)

    def __post_init__(self):
        """most: the greatest share of its least estimate that each row of ``basis`` can give any passage."""
        self.most = np.zeros(len(self.basis))
        for lo, hi in chunks(len(self.basis), 4096):
            if len(self.place):
                self.most[lo:hi] = np.maximum(0, ((self.basis[lo:hi] @ self.place.T) / self.least).max(1))

    def search(self, ids: np.ndarray, n: np.ndarray, texts, found: dict[tuple, tuple]) -> None:
        """Adds to ``found`` the (lcs share, cosine, answer share) of every leak, the best of each (row, item). ids: words of all rows; n: words of each."""
        if not len(ids) or not len(self.place):
            return
        start = np.cumsum(n) - n
        nb = -(-n // STRIDE)
        base = np.cumsum(nb) - nb
        block_row = np.repeat(np.arange(len(n)), nb)
        first = start[block_row] + (np.arange(nb.sum()) - base[block_row]) * STRIDE  # first token of each block
        w = self.idf[ids]
        slot = self.slot[ids]
        inside = slot >= 0
        last = np.minimum(np.arange(len(first)) + WINDOW // STRIDE, (base + nb)[block_row])
        best = np.zeros(len(ids))
        best[inside] = w[inside] * self.most[slot[inside]]
        sums = [np.concatenate([[0.0], np.cumsum(np.add.reduceat(m, first))]) for m in (w * w, best)]
        total, reach = (m[last] - m[: len(first)] for m in sums)
        go = np.flatnonzero(reach >= np.sqrt(total) - 1e-6)
        for lo, hi in chunks(len(go), 4096):
            wins = go[lo:hi]
            blocks = np.unique(np.minimum(wins[:, None] + np.arange(WINDOW // STRIDE), last[wins][:, None] - 1))
            ends = np.concatenate([first, [len(ids)]])
            length = (ends[1:] - first)[blocks]
            at = np.repeat(first[blocks] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            which = np.repeat(np.arange(len(blocks)), length)
            ok = inside[at]
            at, which = at[ok], which[ok]
            folded = np.zeros((len(blocks), self.basis.shape[1]), np.float32)
            if len(at):
                cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                folded[which[cut]] = np.add.reduceat(self.basis[slot[at]] * w[at, None].astype(np.float32), cut, axis=0)
            window = np.zeros((len(wins), folded.shape[1]), np.float32)
            for k in range(WINDOW // STRIDE):
                has = wins + k < last[wins]
                window[has] += folded[np.searchsorted(blocks, wins[has] + k)]
            score = window @ self.place.T / np.sqrt(total[wins])[:, None]
            for i, p in zip(*np.nonzero(score >= self.least), strict=True):
                b = wins[i]
                row = block_row[b]
                item, needle, answer = self.items[p]
                spare = max(STRIDE, len(needle) // 4)
                a, z = max(start[row], first[b] - spare), min(start[row] + n[row], first[b] + WINDOW + spare)
                hay = ids[a:z]
                if len(needle) - len(set(needle.tolist()).difference(hay.tolist())) < PARAPHRASE * len(needle):  # words in common bound the subsequence
                    continue
                share = common_length(needle, hay) / len(needle)
                if share < PARAPHRASE:
                    continue
                said = common_length(answer, hay) / len(answer) if len(answer) else 0.0
                if share >= VERBATIM or said >= ANSWER:
                    best = (share, float(score[i, p]), said)
                    if best > found.get((row, item), (-1.0, 0.0, 0.0)):
                        found[row, item] = best


@dataclass
class Short:
    """Items of fewer than MIN_WORDS words: by length, the rising hashes of their bucket sequences and (hash, item, words)."""

    of_length: dict[int, tuple[np.ndarray, dict[int, list]]]

    @staticmethod
    def rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` buckets from each place on."""
        h = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1)
        return h

    @classmethod
    def of(cls, rows: Iterator[tuple]) -> Short:
        lengths: dict[int, dict[int, list]] = {}
        for item, ids, words in rows:
            lengths.setdefault(len(ids), {}).setdefault(int(cls.rolled(ids, len(ids))[0]), []).append((item, words))
        return cls({n: (np.array(sorted(h), np.uint64), h) for n, h in lengths.items()})

    def search(self, ids: np.ndarray, n: np.ndarray, texts, found: dict[tuple, tuple]) -> None:
        row, start, words = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n, {}
        for size, (hashes, items) in self.of_length.items():
            if len(ids) < size:
                continue
            h = self.rolled(ids, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero((hashes[at] == h) & (row[: len(h)] == row[size - 1 :])):
                r = int(row[i])
                if r not in words:  # buckets may be shared, words decide
                    words[r] = [w for w in map(normal, texts.iloc[r].split()) if w]
                k = int(i - start[r])
                for item, own in items[int(h[i])]:
                    if words[r][k : k + size] == own:
                        found[r, item] = (1.0, 1.0, 1.0)


def search(blocks: list, texts, memo: Memo) -> list[tuple]:
    """(row, item, cosine, lcs share, answer share) of every leak of any block, the best of each (row, item)."""
    found: dict[tuple, tuple] = {}
    ids, sizes = flatten(texts, memo)
    rows = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
    ids = ids[ids >= 0]
    n = np.bincount(rows, minlength=len(sizes))
    for index in blocks:
        index.search(ids, n, texts, found)
    return [(int(row), item, cos, share, said) for (row, item), (share, cos, said) in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def randomised_svd(rows: DataFrame, features: np.ndarray, idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF rows (column ids); each product with the matrix is a pass over ``rows``."""
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((len(features), min(len(features), rank + 8))).astype(np.float32)

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast((features, idf[features], q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, weight, q = shared.value
            out = np.zeros((q.shape[1] if gram else len(f), q.shape[1]), np.float64)
            for b in batches:
                for ids in b["ids"]:
                    at, x = tf_idf(np.asarray(ids), f, weight)
                    y = x @ q[at]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[at] += x[:, None] * y
            step = max(1, (1 << 17) // out.shape[1])
            yield pd.DataFrame({"chunk": range(-(-len(out) // step)), "part": [out[k : k + step].tobytes() for k in range(0, len(out), step)]})

        got = _sum_chunks(rows.select("ids").mapInPandas(run, "chunk int, part binary"), np.float64)
        return np.concatenate([got[k] for k in sorted(got)]).reshape(-1, q.shape[1])

    for _ in range(rounds):
        q = np.linalg.qr(product(q, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(product(q, True))
    order = np.argsort(-values)[:rank]
    return (q @ vectors[:, order[values[order] > 1e-9 * max(values.max(), 1e-30)]]).astype(np.float32)


def tf_idf(ids: np.ndarray, features: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``features``, weights of length 1) of a passage."""
    k, tf = np.unique(ids, return_counts=True)
    at = np.searchsorted(features, k)
    x = tf * weight[at]
    return at, (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def block_of(part: pd.DataFrame, idf: np.ndarray, usual: float, spark: SparkSession, rank: int, cosine: float) -> Index:
    """The latent space of passages of MIN_WORDS words and more: columns item_id, ids, answer."""
    features = np.unique(np.concatenate([np.asarray(p, np.int64) for p in part["ids"]]))
    rows = spark.createDataFrame([(np.asarray(p).tolist(),) for p in part["ids"]], "ids array<int>")
    basis = randomised_svd(rows, features, idf, min(rank, len(part)))
    slot = np.full(len(idf), -1, np.int32)
    slot[features] = np.arange(len(features))
    x = np.zeros((len(part), len(features)), np.float32)
    for k, ids in enumerate(part["ids"]):
        at, w = tf_idf(np.asarray(ids, np.int64), features, idf[features])
        x[k, at] = w
    poor = ((x @ basis) ** 2).sum(1) < KEPT
    if poor.any():
        rest = x[poor] - (x[poor] @ basis) @ basis.T
        q, r = np.linalg.qr(rest.T.astype(np.float64))
        basis = np.concatenate([basis, q[:, np.abs(np.diag(r)) > 1e-6].astype(np.float32)], 1)
    place = x @ basis
    place /= (place * place).sum(1, keepdims=True)
    least = np.array([least_estimate(np.asarray(i, np.int64), idf, usual, cosine) for i in part["ids"]], np.float32)
    listed = [(int(i), np.asarray(p, np.int64), np.asarray(a, np.int64)) for i, p, a in zip(part["item_id"], part["ids"], part["answer"], strict=True)]
    return Index(idf.astype(np.float64), slot, basis, place, least, listed)


def indexes(texts: DataFrame, benchmark: DataFrame, rank: int = RANK, bits: int = BITS, cosine: float = COSINE) -> tuple[int, Iterator[list]]:
    """Of the benchmark (item_id, text) against the documents ``texts``: the number of passes of about AT_ONCE passages, and for
    each pass its index, made when it is asked for: the blocks' latent spaces and the short items."""
    spark = texts.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, p.astype(np.int32), a.astype(np.int32), w) for i, t in zip(b["item_id"], b["text"], strict=True) for _, p, a, w in passages(i, t, bits)]
            yield pd.DataFrame(got, columns=["item_id", "ids", "answer", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    cuts = materialise(items.mapInPandas(cut, "item_id long, ids array<int>, answer array<int>, words array<string>"), "passages").distinct()
    n = cuts.count()
    passes = -(-n // AT_ONCE)
    idf, usual = inverse_frequencies(texts, bits) if n else (None, 0.0)

    def made() -> Iterator[list]:
        for k in range(passes):
            got = cuts.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toPandas()  # about AT_ONCE rows; an item's passages stay together
            got["key"] = [(i, *np.asarray(p).tolist()) for i, p in zip(got["item_id"], got["ids"], strict=True)]
            got = got.sort_values("key").reset_index(drop=True)
            short = got["words"].map(len) > 0
            long, few = got[~short], got[short]
            blocks: list = [block_of(long.iloc[a:b], idf, usual, spark, rank, cosine) for a, b in chunks(len(long), BLOCK)]
            yield blocks + ([Short.of((int(i), np.asarray(p, np.int64), list(w)) for i, p, w in zip(few["item_id"], few["ids"], few["words"], strict=True))] if len(few) else [])

    return passes, made()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).dropna()


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): a row for every document and benchmark item that it holds.

    Null or empty text holds nothing; a null doc_id is returned as such. Repeated documents: a row each; repeated items count
    once. Items that are null or without words aren't searched; those of fewer than MIN_WORDS words are found where a document
    holds their words in a row, with all figures 1. Empty tables: no rows. Documents of any length are searched whole. Other
    columns are ignored.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    # ids travel as text, since pandas would make a column with nulls doubles
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    passes, made = indexes(_texts(docs), benchmark, rank, bits, cosine)
    for blocks in made:
        shared = spark.sparkContext.broadcast(blocks)  # about AT_ONCE passages, whatever the benchmark and the documents

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            blocks, memo = shared.value, hashing(bits)
            for b in batches:
                ids = b["doc_id"].tolist()
                for lo, hi in chunks(len(b), 256):
                    got = search(blocks, b["text"].iloc[lo:hi], memo)
                    yield pd.DataFrame([(None if ids[lo + r] is None else int(ids[lo + r]), *rest) for r, *rest in got], columns=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"]).astype({"doc_id": "Int64"})

        part = rows.mapInPandas(find, schema)
        if passes > 1:  # a pass's index is dropped before the next one is made
            part = materialise(part, "leaks")
            shared.unpersist()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item in the sense of ``leaks``. Rows of null or empty text stay."""
    passes, made = indexes(_texts(docs), benchmark, cosine=cosine)
    for k, blocks in enumerate(made):
        docs = docs.filter(~_holds(docs.sparkSession, blocks)(F.col("text").cast("string")))
        if k < passes - 1:
            docs = materialise(docs, "decontaminated")
    return docs


def _holds(spark: SparkSession, blocks: list):
    shared = spark.sparkContext.broadcast(blocks)

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blocks, memo = shared.value, hashing(BITS)
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            for lo, hi in chunks(len(texts), 256):
                hit[[lo + r for r, *_ in search(blocks, texts.iloc[lo:hi], memo)]] = True
            yield pd.Series(hit)

    return holds


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
