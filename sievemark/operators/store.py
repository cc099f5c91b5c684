"""The record store's rules: replays, conflicts, conformance, order and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(submissions: DataFrame) -> DataFrame:
    """(record_id, body, submissions, bodies, state): a replay is kept once; an id with several bodies is a conflict and keeps none."""
    g = submissions.groupBy("record_id").agg(F.count("*").alias("submissions"), F.count_distinct("body").alias("bodies"), F.min("body").alias("body"))
    clash = F.col("bodies") > 1
    return g.select("record_id", F.when(~clash, F.col("body")).alias("body"), "submissions", "bodies", F.when(clash, "conflict").when(F.col("submissions") > 1, "replayed").otherwise("stored").alias("state"))


def terminal(flags: DataFrame, key: str, declared: str = "declared") -> DataFrame:
    """(key, terminal): a conflict outranks an invalid record, which outranks what the check declared."""
    g = flags.groupBy(key).agg(F.bool_or("conflict").alias("c"), F.bool_or("invalid").alias("i"), F.max(declared).alias("d"))
    return g.select(key, F.when(F.col("c"), "record-conflict").when(F.col("i"), "invalid-record").otherwise(F.col("d")).alias("terminal"))


def first_issue(fields: Column, declared: dict[str, tuple[str, bool]]) -> Column:
    """Conformance of a map of raw values to a closed schema: unknown key, then missing key, then a value of the wrong type; null is sound."""
    keys = F.map_keys(fields)
    names = F.array(*[F.lit(k) for k in sorted(declared)]).cast("array<string>")
    required = F.array(*[F.lit(k) for k, (_, need) in sorted(declared.items()) if need]).cast("array<string>")
    unknown = F.array_sort(F.array_except(keys, names))
    missing = F.array_sort(F.array_except(required, keys))
    forms = {"integer": r"^-?(0|[1-9]\d{0,15})$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": "^(true|false)$"}
    issue = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.get(unknown, 0))).when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.get(missing, 0)))
    for k, (kind, _) in sorted(declared.items()):
        if kind in forms:
            value = F.try_element_at(fields, F.lit(k))
            issue = issue.when(F.array_contains(keys, k) & (value.isNull() | ~value.rlike(forms[kind])), f"type:{k}")
    return issue


def out_of_order(rows: DataFrame, ordinal: str, key: str, span: int = 100_000) -> DataFrame:
    """Rows whose key isn't greater than the one before, by ordinal.

    Rows meet their neighbours within a span of ordinals; the first of a span meets the last of the span before, of which
    there is one row per ``span`` rows, so that no task sorts everything.
    """
    part = rows.withColumn("__s", F.floor(F.col(ordinal) / span))
    inner = part.withColumn("__b", F.lag(key).over(Window.partitionBy("__s").orderBy(ordinal)))
    ends = part.groupBy("__s").agg(F.max_by(key, ordinal).alias("__last"))
    ends = ends.withColumn("__s", F.lead("__s").over(Window.orderBy("__s"))).filter("__s is not null")
    joined = inner.join(ends, "__s", "left").withColumn("__b", F.coalesce("__b", "__last"))
    return joined.filter(F.col("__b") >= F.col(key)).select(*rows.columns)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1")


def orphans(records: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose check or record type isn't in the catalog."""
    return records.join(catalog.select(*keys).distinct(), keys, "left_anti")
