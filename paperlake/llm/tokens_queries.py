"""Queries of the encoding and of the mixture; SQL has no tokenizer, so none is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import mixing, tokens
from paperlake.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_catalog"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_catalog"))[1]


def p7_even(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the mixture whose weights have an entropy half way between the natural and the target ones."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_catalog"), evenness=0.5)[1]


QUERIES = {"p6_ids": p6_ids, "p7_documents": p7_documents, "p7_shares": p7_shares, "p7_even": p7_even}
SQL: dict[str, str] = {}
