"""Shared helpers of the training-data operators: tables, durable intermediates and hashed terms."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's token memo may hold before it is emptied; it only saves time, never changes a value.
MEMO_ENTRIES = 400_000
_C = ctypes.CDLL(None)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor of a cluster sees.

    Only where that setting is missing in local mode (tests) a temporary folder becomes the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, which cuts the lineage and survives the loss of any executor; and its path."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate that no plan will read again."""
    files, at = _place(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def normal(raw: str) -> str:
    """Lower case, without punctuation at either end."""
    word = raw.lower()
    return word if word.isalnum() else _EDGE.sub("", word)


def normals(tokens: list[str]) -> list[str]:
    """``normal`` of each of ``tokens``, which hold no white space."""
    low = "\n".join(tokens).lower().split("\n")
    if len(low) != len(tokens):
        return [normal(t) for t in tokens]
    return [w if good else s if (s := w.strip(_MARKS)).isalnum() else _EDGE.sub("", s) for w, good in zip(low, map(str.isalnum, low), strict=True)]


def codes(tokens: list[str], code) -> tuple[np.ndarray, np.ndarray]:
    """(``code``, a hash of bytes, of each token's normal form, which forms aren't empty). Tokens hold no white space."""
    words = normals(tokens)
    data = "\n".join(words).encode("utf-8", "surrogatepass").split(b"\n") if words else []
    return np.fromiter(map(code, data), np.uint64, len(words)), np.fromiter(map(bool, words), bool, len(words))


def distinct_tokens(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """(each token once, which of them every token is)."""
    try:
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        at: dict[str, int] = {}
        index = np.fromiter((at.setdefault(t, len(at)) for t in tokens), np.int64, len(tokens))
        return list(at), index
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


class Memo(dict):
    """token -> value, computed once per distinct token; emptied when it grows beyond MEMO_ENTRIES. batch: values of distinct tokens
    without white space at once, which are quicker made again than remembered."""

    def __init__(self, compute, batch=None):
        super().__init__()
        self.compute, self.batch = compute, batch

    def of(self, tokens: list[str]) -> np.ndarray:
        """Values of tokens as ``str.split`` gives them."""
        if self.batch is None:
            return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        new, at = distinct_tokens(tokens)
        return self.batch(new)[at]

    def __missing__(self, raw):
        value = self.compute(raw)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[raw] = value
        return value


_MEMOS: dict[object, Memo] = {}


def memo_of(name, compute, batch=None) -> Memo:
    """One table for all tasks of a worker process."""
    if name not in _MEMOS:
        _MEMOS.clear()  # a worker serves one operator at a time
        _MEMOS[name] = Memo(compute, batch)
    return _MEMOS[name]


def hashing(bits: int) -> Memo:
    """token -> ``hashed(token, bits)``."""
    mask = (1 << bits) - 1

    def batch(tokens: list[str]) -> np.ndarray:
        got, some = codes(tokens, zlib.crc32)
        return np.where(some, got.astype(np.int64) & mask, -1)

    return memo_of(bits, lambda t: crc(w) & mask if (w := normal(t)) else -1, batch)


def give_back() -> None:
    """Returns the memory that a worker has freed to the system; else it stays the worker's, beside what other tasks take."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def in_arrow(run, most: int, schema: pa.Schema):
    """``run`` over frames, for mapInArrow: of a batch ``most`` rows at a time are made Python's values, not all of them."""

    def frames(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for lo, hi in chunks(b.num_rows, most):
                yield b.slice(lo, hi - lo).to_pandas()

    def go(batches: Iterable[pa.RecordBatch]):
        for frame in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    return go


def crc(word: str, seed: int = 0) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), seed)


def hashed(raw: str, bits: int) -> int:
    """Bucket of a token's normal form, -1 where nothing but punctuation is left."""
    word = normal(raw)
    return crc(word) & ((1 << bits) - 1) if word else -1


def flatten(texts: Iterable[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(value of every token, number of tokens of every text); null is as empty."""
    tokens: list[str] = []
    sizes = []
    for text in texts:
        words = text.split() if text else ()
        sizes.append(len(words))
        tokens += words
    return memo.of(tokens), np.array(sizes, np.int64)


def chunks(n: int, size: int):
    return ((i, min(n, i + size)) for i in range(0, n, size))


#: Distinct grades that a table of ratings may have; more are an error, since they'd be a measurement to be binned first.
MOST_GRADES = 256


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> tuple[DataFrame, dict[float, float]]:
    """At most ``bound`` labelled documents for fitting, as many of each class as the rarer ones allow, and each class's weight.

    A class's rows are those of the least hash of doc_id, so the choice is the same on any layout. The weight is
    (rows of the class in all labels) / (rows taken), so that a weighted fit sees the real proportions. Rows with a null
    doc_id or label aren't used; NaN counts as null. Of a doc_id labelled twice with different values, each row counts.
    Fractional grades are grades of their own; more than MOST_GRADES distinct ones raise a ValueError.
    """
    y = F.col(target).cast("double")
    rows = labels.select(F.col("doc_id").cast("long").alias("i"), F.when(~F.isnan(y), y).alias("y")).dropna()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").limit(MOST_GRADES + 1).collect()}
    if len(counts) > MOST_GRADES:
        raise ValueError(f"{target} has more than {MOST_GRADES} distinct grades: bin them first")
    if not counts:
        return docs.select(F.lit(0.0).alias("y"), F.lit("").alias("text")).limit(0), {}
    share, left, take = bound, sorted(counts.items(), key=lambda c: c[1]), {}
    for k, (y, n) in enumerate(left):
        take[y] = min(n, share // (len(left) - k))
        share -= take[y]
    parts = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(take[y]) for y in counts if take[y]]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    text = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"))
    # at most `bound` (id, label) rows, a documented parameter, are broadcast
    return text.join(F.broadcast(chosen), "i").select("y", "text"), {y: counts[y] / take[y] for y in take if take[y]}
