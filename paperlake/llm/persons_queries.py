"""Queries of the name variants; reading names is beyond SQL, so none is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import persons
from paperlake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return persons.pairs(table(spark, d, "paper_authors"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return persons.classes(table(spark, d, "paper_authors"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
SQL: dict[str, str] = {}
