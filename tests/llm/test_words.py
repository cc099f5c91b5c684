"""Words' values, and what a worker keeps of them."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sievemark.llm import common, language_model

ODD = ["Don't,", "--", "_a_", "ΟΔΟΣ", "ΣΑΣ.", "İstanbul", "Straße!", "naïve…", "«mot»", "x", "42%", "a_b", "日本語。", "​zero", "é", "__", "ǅ", "\udc80half", "don't,"]


def test_batches_of_words_have_the_values_of_single_ones():
    for tokens in (ODD, [t for t in ODD if "\udc80" not in t], ["--"], []):
        assert common.normals(tokens) == [common.normal(t) for t in tokens]
        assert language_model.word_codes(tokens).tolist() == [language_model.word_code(t) for t in tokens]
        repeated = [*tokens, *tokens[::-1], *tokens[:3]]
        assert common.hashing(18).of(repeated).tolist() == [common.hashed(t, 18) for t in repeated]


def test_neighbours_are_those_of_plain_code():
    texts = ["a b  a", None, "-- !", "", "B, c", "x"]
    u, w, rows = language_model.bigrams(pd.Series(texts), common.memo_of("words", language_model.word_code, language_model.word_codes))
    want = []
    for k, text in enumerate(texts):
        ids = [c for t in (text or "").split() if (c := language_model.word_code(t)) >= 0]
        want += [(a, b, k) for a, b in zip([language_model.START, *ids], [*ids, language_model.END], strict=True)] if ids else []
    assert list(zip(u.tolist(), w.tolist(), rows.tolist(), strict=True)) == want


def test_counting_keeps_no_words_in_the_worker():
    """They stayed beside all that the worker's later tasks take."""
    common._MEMOS.clear()
    texts = pd.DataFrame({"text": [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(300)]})
    rows = pd.concat(list(language_model._count(1)(iter([texts]))))
    assert sum(map(len, common._MEMOS.values())) == 0
    merged = language_model._merge(rows)
    assert int(np.sum(language_model.unpack(merged["blobs"].iloc[0][3]))) == 300 * 101


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_of_texts_is_never_words_as_a_whole():
    """Half a million words as Python's strings took several times what their codes take."""
    texts = pd.Series([" ".join(f"w{(k * 7 + i) % 5000}" for i in range(400)) for k in range(1280)])
    memo = common.memo_of("words", language_model.word_code, language_model.word_codes)
    assert _peak(lambda: language_model.bigrams(texts, memo)) < 50 * 1280 * 400


def test_of_a_batch_only_the_rows_at_hand_are_python_s():
    sizes = []

    def run(frames):
        for f in frames:
            sizes.append(len(f))
            yield f

    batch = pa.RecordBatch.from_pydict({"p": list(range(100)), "blobs": [[bytes([k])] * (k % 3) for k in range(99)] + [None]}, pa.schema([("p", pa.int64()), ("blobs", pa.list_(pa.binary()))]))
    got = pa.Table.from_batches(common.in_arrow(run, 16, batch.schema)(iter([batch, batch.slice(0, 0), batch])))
    assert got.to_pylist() == batch.to_pylist() * 2 and max(sizes) == 16


def test_looking_up_gives_each_task_as_many_parts(spark):
    rows = spark.range(21).select(F.explode(F.array(*[F.lit(k) for k in range(3)])), F.col("id").alias("p"))
    tasks = language_model.tasks_for(rows, 21)
    found = language_model.evenly(rows, 21).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("p").alias("n"), F.count("*").alias("rows")).collect()
    assert len(found) == tasks and max(r["n"] for r in found) == -(-21 // tasks) and sum(r["rows"] for r in found) == 63
