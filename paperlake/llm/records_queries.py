"""Queries of the surviving values and of the linkage; both compare noisy texts beyond SQL, so none is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import linkage, survivors
from paperlake.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "papers"), table(spark, d, "source_catalog"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.pairs(table(spark, d, "papers"), table(spark, d, "search_records"))


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.linked(table(spark, d, "papers"), table(spark, d, "search_records"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_confidence": p3_confidence}
SQL: dict[str, str] = {}
