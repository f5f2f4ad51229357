"""Problem 1: limits and dimensions in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseloom.operators.units import compare_drafts, deviating_drafts
from clauseloom.tables import table


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("sample_rule_drafts", "dimension_annotations", "rule_sources")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviating_drafts(*_inputs(spark, sf_dir))


def p1_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft's limit and its dimension as numbers in common units."""
    return compare_drafts(*_inputs(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_quantities": p1_quantities}
