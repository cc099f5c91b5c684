"""Canonical JSON, digests and identities."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "check-record/v1/record/sha256:"
CATALOG = "check-record/v1/catalog/sha256:"
RECORDS = "check-record/v1/records/sha256:"
REFERENCE = "reference/v1/sha256:"
SAFE = 2**53 - 1


def canonical_text(value: Any) -> str:
    """Driver-side canonical JSON of a definition: sorted keys, compact, finite numbers only, whole doubles without fraction."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("canonical JSON holds finite numbers only")
        if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
            value = int(value)
        return json.dumps(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("canonical JSON has text keys only")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_text(value[k])}" for k in sorted(value)) + "}"
    raise TypeError(f"canonical JSON can't hold a {type(value).__name__}")


def digest_of(value: Any) -> str:
    return hashlib.sha256(canonical_text(value).encode()).hexdigest()


def catalog_fingerprint(checks: list[dict]) -> str:
    """Of definitions in any order: checks by id, record types, fields, operands by theirs, id lists sorted."""

    def record_type(t: dict) -> dict:
        out = {"recordTypeId": t["recordTypeId"], "fields": sorted(t["fields"], key=lambda f: f["fieldId"]), "identityFields": sorted(t["identityFields"])}
        if t.get("policy") is not None:
            out["policy"] = {"operands": sorted(t["policy"]["operands"], key=lambda o: o["operandId"]), "relations": sorted(t["policy"]["relations"])}
        return out

    rows = [{"checkId": c["checkId"], "displayName": c["displayName"], "recordTypes": sorted(map(record_type, c["recordTypes"]), key=lambda t: t["recordTypeId"])} for c in checks]
    return CATALOG + digest_of(sorted(rows, key=lambda c: c["checkId"]))


def canonical(**fields: Column) -> Column:
    """Canonical JSON of a row; keys are sorted, nulls kept. For text, boolean, integer, array and struct columns."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def subject(text: Column) -> Column:
    """Line ends as LF and NFC, without folding case or space. Spark has no NFC, so only texts beyond ASCII go to Python."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(lf.rlike("^[\\x00-\\x7F]*$"), lf).otherwise(F.pandas_udf(_nfc, "string")(F.when(~lf.rlike("^[\\x00-\\x7F]*$"), lf)))


def record_id(check_id: Column, record_type_id: Column, identity: dict[str, Column], semantic_subject: Column) -> Column:
    """Identity of a record; its level, message and location don't count."""
    fields = F.struct(*[identity[k].alias(k) for k in sorted(identity)])
    return F.concat(F.lit(RECORD), sha(canonical(checkId=check_id, identityFields=fields, recordTypeId=record_type_id, semanticSubject=semantic_subject)))


def reference_id(revision: Column) -> Column:
    """Identity of a named reference: of its revision alone."""
    return F.concat(F.lit(REFERENCE), sha(revision))


def ordered_digest(rows: DataFrame, text: str, order: list[str], by: list[str], start: str = "", between: str = "", end: str = "") -> DataFrame:
    """(by..., digest, n): sha256 over ``text`` in ``order`` within ``by``, streamed through one sorted task per group.

    A digest is sequential by nature; memory is bounded since rows are hashed as the external sort yields them.
    """
    keys = ", ".join(f"`{c}` string" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h, n = None, None, 0

        def row():
            h.update(end.encode())
            return pd.DataFrame([[*last, h.hexdigest(), n]], columns=[*by, "digest", "n"])

        for b in batches:
            for *key, t in b[[*by, "__t"]].itertuples(index=False):
                if key != last:
                    if h is not None:
                        yield row()
                    last, h, n = key, hashlib.sha256(start.encode()), 0
                elif n:
                    h.update(between.encode())
                h.update(t.encode())
                n += 1
        if h is not None:
            yield row()

    base = rows.select(*[F.col(c).cast("string").alias(c) for c in by], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(text).alias("__t"))
    spread = base.repartition(*by) if by else base.repartition(1)
    spread = spread.sortWithinPartitions(*by, *[f"__o{i}" for i in range(len(order))])
    return spread.mapInPandas(run, (keys + ", " if keys else "") + "digest string, n long")


def records_fingerprint(records: DataFrame, row: Column | None = None) -> DataFrame:
    """One row (fingerprint, n) over the records' JSON in order of record_id; an empty set has a fingerprint too."""
    spark = records.sparkSession
    rows = records.select("record_id", (F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}) if row is None else row).alias("row"))
    some = ordered_digest(rows, "row", ["record_id"], [], "[", ",", "]")
    none = spark.range(1).select(F.lit(hashlib.sha256(b"[]").hexdigest()).alias("digest"), F.lit(0).cast("long").alias("n"))
    best = some.unionByName(none).orderBy(F.desc("n")).limit(1)
    return best.select(F.concat(F.lit(RECORDS), "digest").alias("fingerprint"), "n")
