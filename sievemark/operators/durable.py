"""Intermediates that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder that ``spark.checkpoint.dir`` names; in local mode a temporary one will do."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
