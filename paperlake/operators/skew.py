"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most HOT_SHARE ** -1 keys are hot.
HOT_SHARE = 0.002
#: Below this many rows a key is never hot.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Keys that hold at least ``share`` of the rows and ``least`` rows.

    The counts are combined before the shuffle. At most ``1 / share`` keys can
    qualify, which bounds what comes to the driver.
    """
    total = df.count()
    need = max(least, int(total * share))
    if total < need:
        return []
    counts = df.where(key.isNotNull()).groupBy(key.alias("k")).count()
    return [r[0] for r in counts.where(F.col("count") >= need).select("k").collect()]


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    right_key: str,
    spread: Column,
    hot: list,
    how: str = "left",
    slices: int = 64,
) -> DataFrame:
    """Join ``left`` with ``right`` (unique on ``right_key``), hot keys salted.

    Rows of a hot key go to ``slices`` tasks by ``spread``; only the at most
    ``len(hot)`` rows of ``right`` for those keys are repeated.
    """
    if not hot:
        return left.join(right, F.col(key) == F.col(right_key), how)
    a = left.withColumn(
        "_salt",
        F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(slices))).otherwise(F.lit(0)).cast("int"),
    )
    salts = F.when(F.col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(
        F.array(F.lit(0))
    )
    b = right.withColumn("_rsalt", F.explode(salts))
    return a.join(b, (F.col(key) == F.col(right_key)) & (F.col("_salt") == F.col("_rsalt")), how).drop(
        "_salt", "_rsalt"
    )


#: Rows of one key that one task of ``dealt`` sets against all rows of the key.
SLICE = 512


def dealt(df: DataFrame, keys: list[str], by: str, rows: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """``df`` twice for a join with itself on ``keys`` and ``_slice``; keys of one row are left out.

    The first has each row in one of its key's slices (by a hash of ``by``), the second in
    all of them, so a key of n rows is n / ``rows`` tasks' work instead of one's.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    some = df.join(n, keys).withColumn("_slices", F.ceil(F.col("_n") / rows).cast("int")).drop("_n")
    left = some.withColumn("_slice", F.pmod(F.xxhash64(by), F.col("_slices")).cast("int")).drop("_slices")
    right = some.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return left, right
