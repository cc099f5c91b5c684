"""A blocked Bloom filter over 64-bit keys: built by one aggregation, tested in Arrow batches.

A key sets one bit in each of the four 64-bit words of one block, so a test touches 32 adjacent bytes. The bit array is sent to
all workers, so a filter is cut by key range into slices of MOST_BYTES at most. Each slice is broadcast by itself and tests the
rows of its own range, in a pass over the rows for each slice; the keys of 44 million rows fit one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import fresh

BITS_PER_KEY = 12
MOST_BYTES = 64 << 20
MOST_PASSES = 4


@dataclass
class Blocked:
    """words: blocks x 4."""

    words: np.ndarray

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        """keys: int64, as ``xxhash64`` gives them. No false negatives."""
        k = keys.astype(np.int64).view(np.uint64)
        block = (k >> np.uint64(32)) % np.uint64(len(self.words))
        hit = np.ones(len(k), bool)
        for j in range(4):
            bit = (k >> np.uint64(6 * j)) & np.uint64(63)
            hit &= ((self.words[block, j] >> bit) & np.uint64(1)).astype(bool)
        return hit


def slice_of(k: Column, slices: int) -> Column:
    """The slice of a key: by its range of the upper bits, which blocks within a slice don't follow."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(k), 40), F.lit(slices)).cast("int") if slices > 1 else F.lit(0)


def build(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bytes: int = MOST_BYTES) -> list[Blocked]:
    """The slices of a filter of the one column of ``keys``, a long without nulls. Each is of ``most_bytes`` or of one block at most."""
    keys = keys.toDF("k")
    n = keys.count()
    slices = max(1, -(-n * bits_per_key // (8 * max(32, most_bytes))))
    blocks = max(1, -(-n * bits_per_key // (256 * slices)))
    block = F.shiftrightunsigned("k", 32) % F.lit(blocks)
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {6 * j}) & 63 as int))")).alias(f"w{j}") for j in range(4)]
    set_ = keys.groupBy(slice_of(F.col("k"), slices).alias("s"), block.cast("long").alias("b")).agg(*bits)
    made = []
    for s in range(slices):
        got = set_.filter(F.col("s") == s).toPandas()  # one row a block: most_bytes at most
        words = np.zeros((blocks, 4), np.uint64)
        words[got["b"].to_numpy(np.int64)] = got[["w0", "w1", "w2", "w3"]].to_numpy(np.int64).view(np.uint64)
        made.append(Blocked(words))
    return made


def _tester(spark: SparkSession, filter_: Blocked):
    shared = spark.sparkContext.broadcast(filter_)  # MOST_BYTES at most

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(shared.value.might_contain(keys.to_numpy(np.int64)))

    # nulls are replaced before pandas sees them: it would make the keys doubles
    return lambda k: test(F.coalesce(k, F.lit(0).cast("long"))) & k.isNotNull()


def tested(rows: DataFrame, k: Column, made: list[Blocked], name: str) -> DataFrame:
    """``rows`` with the column ``name``: whether key ``k`` may be among the filter's. Null keys aren't."""
    parts = []
    for s, one in enumerate(made):
        own = rows if len(made) == 1 else rows.filter(F.coalesce(slice_of(k, len(made)), F.lit(0)) == s)
        parts.append(own.withColumn(name, _tester(rows.sparkSession, one)(k)))
    return reduce(DataFrame.unionByName, parts)


def key(*columns: str) -> Column:
    """Hash of the columns; null where one of them is null."""
    some = F.lit(True)
    for c in columns:
        some = some & F.col(c).isNotNull()
    return F.when(some, F.xxhash64(*columns))


def _worth(keys: DataFrame) -> list[Blocked] | None:
    """A filter of MOST_PASSES slices at most: beyond, one shuffle of the rows costs less than so many passes over them."""
    keys = keys.dropna()
    return build(keys) if keys.count() * BITS_PER_KEY <= 8 * MOST_BYTES * MOST_PASSES else None


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that may join ``keys`` on ``on``: what a join needs to shuffle. All rows where a filter isn't worth it."""
    name, made = fresh(rows, "maybe"), _worth(keys.select(key(*on)))
    return rows if made is None else tested(rows, key(*on), made, name).filter(F.col(name)).drop(name)


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Anti join of which only the possible hits are shuffled. Rows with a null in ``on`` stay."""
    gone, name = gone.select(*on), fresh(rows, "maybe")
    columns, made = [F.col(f"`{c}`") for c in rows.columns], _worth(gone.select(key(*on)))
    if made is None:
        return rows.join(gone, on, "left_anti").select(*columns)
    marked = tested(rows, key(*on), made, name)
    rest = marked.filter(F.col(name)).drop(name).join(gone, on, "left_anti").select(*columns)
    return marked.filter(~F.col(name)).select(*columns).unionByName(rest)
