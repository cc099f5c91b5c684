"""Publication (K1-K5, K8, K9, S19, V9, V10): two files that a reader can verify, replaced together or not at all."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.canonical import records_fingerprint

RUN, RECORDS, REPORT = "run.json", "records.ndjson", "report.md"
RETIRED = ("result.json", "summary.json")


def row_json(records: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})


def write_ndjson(rows: DataFrame, path: str) -> int:
    """One JSON row per line, in order of record_id, streamed from the executors partition by partition; an empty set is an empty file."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for r in rows.select("record_id", row_json(rows).alias("j")).orderBy("record_id").toLocalIterator():
            out.write(r["j"] + "\n")
            n += 1
    return n


def publish(records: DataFrame, run: dict, folder: str, report: str = "") -> dict:
    """Write all under temporary names, verify, then rename run, records and report; a failure after the first rename removes the set."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    own = f".{uuid.uuid4().hex}.tmp"
    seal = records_fingerprint(records, row_json(records)).first()
    run = run | {"recordsFingerprint": seal["fingerprint"], "recordCount": seal["n"]}
    temps = {name: at / (name + own) for name in (RUN, RECORDS, REPORT)}
    moved: list[Path] = []
    try:
        if write_ndjson(records, str(temps[RECORDS])) != seal["n"]:
            raise ValueError("the records changed while they were published")
        temps[RUN].write_text(json.dumps(run, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        temps[REPORT].write_text(report, encoding="utf-8")
        for name in (RUN, RECORDS, REPORT):
            os.replace(temps[name], at / name)
            moved.append(at / name)
    except BaseException:
        for p in [*moved, *temps.values()]:
            p.unlink(missing_ok=True)
        raise
    for name in RETIRED:
        (at / name).unlink(missing_ok=True)
    return run


def read(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """The verified set: UTF-8 without a mark, a final line feed, no blank line, ids rising, the fingerprint right; the first failure is raised."""
    raw = (Path(folder) / RECORDS).read_bytes()
    run = json.loads((Path(folder) / RUN).read_text("utf-8"))
    if raw.startswith(b"\xef\xbb\xbf"):
        raise ValueError("encoding: byte-order mark")
    text = raw.decode("utf-8")
    if text and not text.endswith("\n"):
        raise ValueError("framing: no final line feed")
    lines = text.split("\n")[:-1]
    if any(not s.strip() for s in lines):
        raise ValueError("framing: blank line")
    schema = spark.read.json(spark.sparkContext.parallelize(lines)).schema if lines else None
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "ordinal long, line string")
    got = rows.select("ordinal", F.col("line").alias("row"), F.get_json_object("line", "$.record_id").alias("record_id"))
    if got.filter("record_id is null").limit(1).count():
        raise ValueError("schema: a row without record_id")
    from sievemark.operators.store import out_of_order

    if out_of_order(got, "ordinal", "record_id").limit(1).count():
        raise ValueError("order: ids don't rise")
    if records_fingerprint(got, F.col("row")).first()["fingerprint"] != run.get("recordsFingerprint"):
        raise ValueError("fingerprint: the records differ from those published")
    return run, rows.select(F.from_json("line", schema).alias("r")).select("r.*") if schema is not None else rows.select(F.lit("").alias("record_id")).filter("false")


def problems(records: DataFrame, catalog: DataFrame, relations: DataFrame) -> DataFrame:
    """(issue, id) of a set of facts (J16, J17, V9): unknown record types, repeated ids, relations of unknown records."""
    loose = records.join(catalog.select("check_id", "record_type_id").distinct(), ["check_id", "record_type_id"], "left_anti").select(F.lit("unknown-type").alias("issue"), F.col("record_id").alias("id"))
    twice = records.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated-id").alias("issue"), F.col("record_id").alias("id"))
    dangling = relations.join(records.select("record_id").distinct(), "record_id", "left_anti").select(F.lit("dangling-relation").alias("issue"), F.col("record_id").alias("id"))
    return loose.union(twice).union(dangling).distinct()


def report(records: DataFrame, n: int = 20) -> str:
    """Markdown of the first n records of each level."""
    from sievemark.operators.evidence import top

    rows = top(records.select("record_id", "level", "semantic_subject", "message"), "level", ["record_id"], n).orderBy("level", "rank").collect()  # n rows a level
    out = ["# Findings", ""]
    for level in dict.fromkeys(r["level"] for r in rows):
        out += [f"## {level}", "", *[f"- {r['message']}" for r in rows if r["level"] == level], ""]
    return "\n".join(out)


def summary(records: DataFrame, n: int = 5) -> str:
    """A preview of n rows and how many more there are."""
    total = records.count()
    lines = [r["message"] for r in records.orderBy("record_id").select("message").limit(n).collect()]
    return "\n".join(lines + ([f"{total - len(lines)} more"] if total > len(lines) else []))


def owned_paths(folder: str) -> list[str]:
    """What a cleanup may remove: the canonical files, the retired ones and own temporaries."""
    at = Path(folder)
    return sorted(str(p) for p in [*(at / n for n in (RUN, RECORDS, REPORT, *RETIRED)), *at.glob(".*.tmp"), *at.glob("*.tmp")] if p.exists())
