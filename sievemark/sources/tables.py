"""The driver tables bound to the engine's entities: files, functions, areas and their baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.measure import measured_files
from sievemark.operators.scope import Area, area_of

AREAS = [Area("english", ("en/**",), ("en/src7/**",)), Area("german", ("de/**",), (), "watchlist-only"), Area("french", ("fr/**",), (), "exclude-warnings")]
GENERATED = ["**/src19/**"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """(doc_id, path, language, area[, text])."""
    d = table(spark, sf_dir, "documents")
    out = d.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), *(["text"] if text else []))
    return out.withColumn("area", area_of(F.col("path"), AREAS, GENERATED))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_files(files(spark, sf_dir)).drop("text")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value): the earlier state of the files of all sources but src3, measured as distinct lines that aren't blank."""
    f = files(spark, sf_dir).filter("path not like '%/src3/%'")
    return f.select("path", F.size(F.array_distinct(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""))).cast("long").alias("value"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): the files that reviewers marked, here those labelled toxic."""
    marked = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return files(spark, sf_dir, False).join(marked, "doc_id", "left_semi").select("path")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, name, start_line, lines, ccn, params, ordinal): the turns of conversations as functions of a file."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv/"), "conv_id").alias("file"), F.col("role").alias("name"), (F.col("turn") + 1).alias("start_line"),
        F.regexp_count("text", F.lit("[^ \\n]+")).cast("long").alias("lines"), F.nullif(F.regexp_count("text", F.lit(",")).cast("long"), F.lit(0).cast("long")).alias("ccn"),
        F.col("turn").alias("params"), F.col("turn").alias("ordinal"),
    )
