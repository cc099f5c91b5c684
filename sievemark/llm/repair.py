"""Token-id output with Re-Pair grammar compression.

Texts become ids of a public byte-level vocabulary (its file's path is a parameter). Each task gathers the documents it reads
into shards of about SHARD ids. In a shard, frequent pairs of ids are repeatedly replaced by nonterminals: a round takes, in
falling order of count, the pairs whose left and right symbols don't also serve the other side, so that no two occurrences
overlap and all are replaced at once. Pairs never reach across documents.
A round takes pairs of a SHARE-th of the most frequent one's count and more. The rules and their expansion lengths are stored, so
one document, or one id of it, is decoded without the rest.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import chunks, table

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Nonterminals begin here; the vocabulary's ids are below.
FIRST_RULE = 50_257
SHARD = 1_000_000
#: A pair of fewer occurrences isn't replaced: its rule of three numbers would cost as much as it saves.
LEAST = 4
#: A round takes pairs of this share of the most frequent one's count and more; 1 would take one count at a time.
SHARE = 16
#: Pieces that a worker remembers before it begins anew.
PIECES = 1_000_000
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a text of single spaces and line feeds between words doesn't hold.
_IRREGULAR = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + ("  ", "\n\n", " \n", "\n ")
SCHEMA = "shard_id string, doc_ids array<long>, starts array<int>, id_counts array<long>, ids binary, rule_left binary, rule_right binary, rule_length binary"


#: A vocabulary file is sent to all workers, so its size is bounded.
MOST_BYTES = 64 << 20


def vocabulary_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """Ids of texts, from a table of the pieces met so far.

    A single space always begins a piece of the vocabulary's pattern, so the spans between single spaces are encoded apart, once
    each; texts with other runs of white space are encoded whole. Emptied beyond PIECES, which changes no result.
    """

    def __init__(self, data: bytes):
        self.enc, self.at = encoding(data), {}
        self.returns = self.enc.encode_ordinary("\r\r a")[:-1]
        self.flat, self.used, self.first, self.count = np.zeros(1 << 20, np.int32), 0, np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def learn(self, new: set[str]) -> None:
        if len(self.at) > PIECES:
            self.at.clear()
            self.used = 0
        starts = [p for p in new if p[:1] == " "]
        later = list(new.difference(starts))
        # between pieces that begin with a space, two carriage returns are a piece of their own; no piece holds one
        ids = np.array(self.enc.encode_ordinary("\r\r " + "\r\r ".join(later)) if later else [], np.int32)
        marks = np.isin(ids, self.returns)
        owner = np.cumsum(marks & ~np.concatenate([[False], marks[:-1]])) - 1 if later else np.zeros(0, np.int64)
        sizes = np.bincount(owner[~marks], minlength=len(later))[: len(later)]
        first = [self.enc.encode_ordinary(p[1:]) for p in starts]
        ids = np.concatenate([ids[~marks], np.fromiter(chain.from_iterable(first), np.int32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, first), np.int64, len(first))])
        k, total = len(self.at), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(sizes) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + total] = ids
        self.first[k : k + len(sizes)], self.count[k : k + len(sizes)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.at.update(zip(chain(later, starts), range(k, k + len(sizes)), strict=True))

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of every text, as ``enc.encode_ordinary`` gives them; null is as empty."""
        words: list[str] = []
        sizes, odd = [], {}
        for k, text in enumerate(texts):
            if not text:
                sizes.append(0)
            elif any(map(text.__contains__, _IRREGULAR)) or text[-1].isspace():
                odd[k] = np.array(self.enc.encode_ordinary(text), np.int32)
                sizes.append(0)
            else:
                own = text.split(" ")  # in the table a piece stands for itself after a space,
                own[0] = " " + own[0]  # and after one that no split leaves, for itself at a text's start
                words += own
                sizes.append(len(own))
        try:
            which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(set(words).difference(self.at) if len(self.at) <= PIECES else set(words))
            which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n = self.count[which]
        flat = self.flat[np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)]
        return [odd.get(k, x) for k, x in enumerate(np.split(flat, cuts[:-1]))] if sizes else []


@lru_cache(maxsize=2)
def pieces(data: bytes) -> Pieces:
    """One table for all tasks of a worker process."""
    return Pieces(data)


def _counted(x: np.ndarray, pos: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs at ``pos`` that occur ``least`` times or more: (their places, pair of each, left << 32 | right, counts)."""
    wide, deep = top.bit_length(), len(pos).bit_length()
    if 2 * wide + deep <= 63:  # pair and place in one number, so that a plain sort brings equal pairs together
        key = ((x[pos].astype(np.int64) << wide) | x[pos + 1]) << deep
        key |= np.arange(len(pos))
        key.sort()
        good, order = key >> deep, key & ((1 << deep) - 1)
    else:
        key = (x[pos].astype(np.int64) << wide) | x[pos + 1]
        order = np.argsort(key, kind="stable")
        good = key[order]
    edge = np.ones(len(good) + 1, bool)
    np.not_equal(good[1:], good[:-1], out=edge[1:-1])
    cut = np.flatnonzero(edge)
    n = np.diff(cut)
    some = np.flatnonzero(n >= least)
    n, pairs = n[some], good[cut[some]]
    which = np.full(len(pos), -1, np.int32)
    which[order[np.repeat(cut[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = np.repeat(np.arange(len(n), dtype=np.int32), n)
    live = which >= 0
    return pos[live], which[live], (pairs >> wide) << 32 | pairs & ((1 << wide) - 1), n


def compress(x: np.ndarray, first_rule: int = FIRST_RULE, least: int = LEAST, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compressed ids, left, right of each rule). -1 in ``x`` is never part of a pair.

    A pair that occurs fewer than ``least`` times never will again, since a replacement makes only pairs with its new symbol. So a
    round counts the places left over from the last one and those beside a replacement, not all.
    """
    x = x.astype(np.int32)
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    top = first_rule
    pos = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
    while len(pos):
        pos, which, pairs, n = _counted(x, pos, top, least)
        if not len(n):
            break
        often = np.flatnonzero(n >= max(least, int(n.max()) // share))
        often = often[np.argsort(-n[often], kind="stable")]
        side, taken = bytearray(top), []  # 1: left of pairs, 2: right, 3: doubled
        chosen = pairs[often]
        for k, a, b in zip(often.tolist(), (chosen >> 32).tolist(), (chosen & 0xFFFFFFFF).tolist()):  # noqa: B905
            if a == b:
                if not side[a]:
                    side[a] = 3
                    taken.append(k)
            elif side[a] in (0, 1) and side[b] in (0, 2):
                side[a], side[b] = 1, 2
                taken.append(k)
        taken.sort()
        rule = np.full(len(pairs), -1, np.int32)
        rule[taken] = np.arange(len(taken))
        k = rule[which]
        at, k = pos[k >= 0], k[k >= 0]
        accepted = pairs[taken]
        double = (accepted >> 32 == accepted & 0xFFFFFFFF)[k]
        if double.any():  # of a run only every other place
            d = at[double]
            begin = np.concatenate([[True], d[1:] != d[:-1] + 1])
            start = np.maximum.accumulate(np.where(begin, d, 0))
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(double)] = (d - start) % 2 == 0
            at, k = at[keep], k[keep]
        worth = np.bincount(k, minlength=len(taken)) >= 2
        name = np.cumsum(worth) - 1 + top
        at, k = at[worth[k]], k[worth[k]]
        if not len(at):
            break
        lefts.append((accepted >> 32)[worth])
        rights.append((accepted & 0xFFFFFFFF)[worth])
        x[at] = name[k]
        live = np.zeros(len(x), bool)
        live[pos] = live[at] = live[np.maximum(at - 1, 0)] = True
        mask = np.ones(len(x), bool)
        mask[at + 1] = False
        x, live = x[mask], live[mask]
        pos = np.flatnonzero(live[:-1])
        pos = pos[(x[pos] >= 0) & (x[pos + 1] >= 0)]
        top += int(worth.sum())
    empty = np.zeros(0, np.int64)
    return x, np.concatenate([empty, *lefts]), np.concatenate([empty, *rights])


def lengths(left: np.ndarray, right: np.ndarray, first_rule: int = FIRST_RULE) -> np.ndarray:
    """Ids that each rule expands to; a rule's symbols are older than the rule."""
    out = np.ones(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = (out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1)
    return out


class Shard:
    """A row of ``shards`` for reading."""

    def __init__(self, row, first_rule: int = FIRST_RULE):
        self.ids = np.frombuffer(row["ids"], np.int32)
        self.starts = [*row["starts"], len(self.ids)]
        self.left, self.right = (np.frombuffer(row[k], np.int32) for k in ("rule_left", "rule_right"))
        self.length = np.frombuffer(row["rule_length"], np.int32).astype(np.int64)
        self.first = first_rule

    def document(self, k: int) -> list[int]:
        """All ids of the k-th document."""
        stack, out = self.ids[self.starts[k] : self.starts[k + 1]][::-1].tolist(), []
        while stack:
            s = stack.pop()
            if s < self.first:
                out.append(s)
            else:
                stack += (int(self.right[s - self.first]), int(self.left[s - self.first]))
        return out

    def id_at(self, k: int, i: int) -> int:
        """The i-th id of the k-th document, found by expansion lengths."""
        own = self.ids[self.starts[k] : self.starts[k + 1]]
        size = np.where(own < self.first, 1, self.length[np.maximum(own - self.first, 0)] if len(self.length) else 1)
        ends = np.cumsum(size)
        if i < 0 or not len(own) or i >= ends[-1]:
            raise IndexError(i)
        at = int(np.searchsorted(ends, i, "right"))
        s, i = int(own[at]), i - int(ends[at] - size[at])
        while s >= self.first:
            a = int(self.left[s - self.first])
            n = int(self.length[a - self.first]) if a >= self.first else 1
            s, i = (a, i) if i < n else (int(self.right[s - self.first]), i - n)
        return s


def _shard(name: str, docs: list, parts: list[np.ndarray]) -> pd.DataFrame:
    gap = np.array([-1], np.int32)
    x, left, right = compress(np.concatenate([a for p in parts for a in (p, gap)]))
    ends = np.flatnonzero(x == -1)
    starts = np.concatenate([[0], ends[:-1] - np.arange(len(ends) - 1)]).astype(np.int32)
    row = {"shard_id": name, "doc_ids": docs, "starts": starts, "id_counts": [len(p) for p in parts], "ids": x[x >= 0].astype(np.int32).tobytes()}
    row |= {"rule_left": left.astype(np.int32).tobytes(), "rule_right": right.astype(np.int32).tobytes(), "rule_length": lengths(left, right).astype(np.int32).tobytes()}
    return pd.DataFrame([row])


def shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """One row a shard: shard_id, doc_ids, starts (each document's place in ids), id_counts (its ids when expanded), ids (int32),
    rule_left, rule_right and rule_length (int32). Read it with ``Shard``.

    Every row of ``docs`` is in one shard, in reading order; which, follows the input's splits. A document isn't cut: one of more ids
    than ``shard`` ends its shard. Null and empty texts have no ids but keep their place. Null doc_ids stay null, repeated rows
    are stored each. Empty table: no rows. Other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))  # MOST_BYTES at most; only the driver needs the path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = pieces(shared.value)
        names, parts, size, k, task = [], [], 0, 0, TaskContext.get().partitionId()
        for b in batches:
            found = (x for lo, hi in chunks(len(b), 512) for x in table_.ids(b["text"].iloc[lo:hi].tolist()))
            for i, part in zip(b["doc_id"].tolist(), found, strict=True):
                names.append(None if i is None else int(i))
                parts.append(part)
                size += len(part)
                if size >= shard:
                    yield _shard(f"{task:06d}-{k:06d}", names, parts)
                    names, parts, size, k = [], [], 0, k + 1
        if names:
            yield _shard(f"{task:06d}-{k:06d}", names, parts)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
