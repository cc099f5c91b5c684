"""The record store over a stream: each id's first body is kept in state; replays pass silently, a different body marks a conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(stream: DataFrame) -> DataFrame:
    """(record_id, body, submissions, state) of a stream of (record_id, body), in update mode. State is bounded to two bodies an id."""
    g = stream.groupBy("record_id").agg(F.count("*").alias("submissions"), F.min("body").alias("low"), F.max("body").alias("high"))
    clash = F.col("low") != F.col("high")
    return g.select("record_id", F.when(~clash, F.col("low")).alias("body"), "submissions", F.when(clash, "conflict").when(F.col("submissions") > 1, "replayed").otherwise("stored").alias("state"))


def run(stream: DataFrame, out: str, checkpoint: str):
    """All that is there now into a folder of Parquet, one subfolder for each micro-batch; the latest row of an id counts."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return settled(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
