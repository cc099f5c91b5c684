"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import chat, decontamination, exact_dedup, language_model, near_dedup, packing, quality, repair, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": urls.query,
        "op2_quality": quality.query,
        "op3_chat": chat.query,
        "op4_packing": packing.query,
        "op5_toxicity": toxicity.query,
        "op6_decontamination": decontamination.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_language_model": language_model.query,
        "op9_repair": repair.query,
        "op10_near_dedup": near_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_urls": urls.ORACLE, "op3_chat": chat.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
