"""Measures of texts and rows (M1-M5). The engine's own definitions: a code line is a line that isn't blank, a decision token one of ``.,;:!?``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = 2**53 - 1


def measured_files(files: DataFrame) -> DataFrame:
    """Adds lines, code_lines, blank_lines and decision_tokens (null for a null text) to path, language, text."""
    lines = F.split("text", "\n")
    out = files.withColumn("lines", F.size(lines).cast("long")).withColumn("code_lines", F.size(F.filter(lines, lambda s: F.trim(s) != "")).cast("long"))
    known = F.col("text").isNotNull()
    out = out.withColumn("lines", F.when(known, F.col("lines"))).withColumn("code_lines", F.when(known, F.col("code_lines")))
    return out.withColumn("blank_lines", F.col("lines") - F.col("code_lines")).withColumn("decision_tokens", F.regexp_count("text", F.lit("[.,;:!?]")).cast("long"))


def valid_count(c: Column) -> Column:
    return c.isNotNull() & (c >= 0) & (c <= SAFE)


def repeated_lines(files: DataFrame, tokens: int) -> DataFrame:
    """Lines of ``tokens`` words or more that two or more files of one area share: (area, line, token_count, locations).

    Shorter lines are dropped before the shuffle; longer ones are combined on the map side by (area, line).
    """
    line = files.select("area", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.size(F.split(F.trim("line"), " +"))
    kept = line.withColumn("token_count", words.cast("long")).filter(F.col("token_count") >= tokens)
    return (
        kept.groupBy("area", "line").agg(F.max("token_count").alias("token_count"), F.count_distinct("path").alias("files"), F.array_sort(F.collect_list(F.struct("path", (F.col("pos") + 1).cast("long").alias("start_line")))).alias("locations")).filter("files >= 2").drop("files")
    )


def minimum_tokens(areas: DataFrame, overrides: DataFrame, default: int) -> DataFrame:
    """(area, min_tokens): the area's own where there is one."""
    return areas.join(overrides, "area", "left").select("area", F.coalesce("min_tokens", F.lit(default)).cast("long").alias("min_tokens"))
