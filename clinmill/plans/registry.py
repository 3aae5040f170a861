"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinmill.plans import curation, dialogues, measures, stages

MODULES = (curation, dialogues, measures, stages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to records, checked, grouped by text and counted per language."""
    return curation.document_texts(spark, folder)
