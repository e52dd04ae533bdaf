"""Queries of this package over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_rules,
    token_count,
    toxicity,
    url_filter,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.op1_toxicity(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op2_token_count": _over("documents", token_count.op2_token_count),
        "op3_mixing": lambda spark, sf_dir: mixing.op3_mixing(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op4_chat_format": _over("conversations", chat_format.op4_chat_format),
        "op5_decontamination": lambda spark, sf_dir: decontamination.op5_decontamination(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        "op6_near_dedup": _over("documents", near_dedup.near_duplicates),
        "op7_line_dedup": _over("documents", line_dedup.op7_line_dedup),
        "op8_quality_rules": _over("documents", quality_rules.op8_quality_rules),
        "op9_url_filter": _over("pages", url_filter.filter_urls),
        "op10_language_id": _over("documents", language_id.op10_language_id),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_near_dedup": near_dedup.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_quality_rules": quality_rules.oracle(),
    }
