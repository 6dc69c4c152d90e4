"""Queries of the long shared spans; tested against brute force, SQL is too slow on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import spans
from paperlake.session import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs(table(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p8_coverage": p8_coverage}
SQL: dict[str, str] = {}
