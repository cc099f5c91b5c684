"""Reference evidence and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["check_id", "reference_name"]


def required_evidence(required: DataFrame, submitted: DataFrame) -> DataFrame:
    """(check_id, reference_name, status) for each required pair; a missing one is unavailable, others are dropped."""
    got = submitted.groupBy(*PAIR).agg(F.min("status").alias("status"))
    return required.select(*PAIR).distinct().join(got, PAIR, "left").select(*PAIR, F.coalesce("status", F.lit("unavailable")).alias("status"))


def required_relations(relations: DataFrame, required: DataFrame) -> DataFrame:
    return relations.join(required.select(*PAIR).distinct(), PAIR, "left_semi")


def resolved(relations: DataFrame, records: DataFrame) -> DataFrame:
    """Relations of retained records; if one names an unknown record, the whole submission of its check is invalid and dropped."""
    known = records.select("record_id").distinct().withColumn("__known", F.lit(True))
    marked = relations.join(known, "record_id", "left")
    sound = marked.groupBy("check_id").agg(F.bool_and(F.col("__known").isNotNull()).alias("__sound"))
    return marked.join(sound, "check_id").filter("__sound").drop("__known", "__sound")


def violations(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_id, reference_name, issue): evidence not complete, or more than one relation of a (record, reference)."""
    state = evidence.select(*PAIR, "status")
    loose = relations.join(state, PAIR, "left").filter(F.coalesce("status", F.lit("unavailable")) != "complete").select("record_id", "reference_name", F.lit("incomplete-evidence").alias("issue"))
    many = relations.groupBy("record_id", "reference_name").agg(F.count("*").alias("n")).filter("n > 1").select("record_id", "reference_name", F.lit("several-relations").alias("issue"))
    return loose.union(many).distinct()
