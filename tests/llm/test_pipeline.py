"""The pipeline over sf0.001: each stage's rows against a plain reading of its decision."""

from __future__ import annotations

import corpus_pipeline as P
import pytest

import __spark_entry__ as E
from sievemark.llm import decontamination, exact_dedup, near_dedup, toxicity
from sievemark.llm.common import materialise, table

D = "/root/testdata/sf0.001"


def test_registered_with_ten_operators():
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, D, "documents")]
    for name, stage in P.STAGES:
        docs.append(materialise(stage(spark, docs[-1], D), name))
    return docs


def test_each_stage_drops_what_its_operator_names(spark, stages):
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    start, clean, exact, near, decont, packed = stages
    for df in (clean, exact, near, decont):
        assert df.columns == start.columns
    toxic = {r["doc_id"] for r in toxicity.toxicity(start, table(spark, D, "labels")).filter("toxic").collect()}
    assert ids(clean) == ids(start) - toxic
    texts = {}
    for r in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        texts.setdefault(r["text"], r["doc_id"])
    assert ids(exact) == set(texts.values())
    assert not exact_dedup.duplicates(exact).count()
    assert ids(near) == ids(exact) - ids(near_dedup.near_duplicates(exact))
    leaks = ids(decontamination.leaks(near, table(spark, D, "benchmark")))
    assert ids(decont) == ids(near) - leaks
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in decont.collect() if r["text"].split()}
