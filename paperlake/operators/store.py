"""Knowledge bases on Parquet: catalogue, chunks, upserts, statistics and staged loads.

A knowledge base is a directory ``<root>/<table>/kb_name=<name>`` so that one
is read, counted or dropped without touching others. Data is written to a
staging directory and renamed when it is complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``new`` and the rows of ``old`` it does not replace; columns in ``keep`` stay as they were (created_at)."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(before, keys, "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``; rows with a null key stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def stats(chunks: DataFrame, kb: str = "kb_name", paper: str = "paper_id") -> DataFrame:
    """kb, chunks, papers (exact)."""
    return chunks.groupBy(kb).agg(F.count("*").alias("chunks"), F.countDistinct(paper).alias("papers"))


def with_live_counts(meta: DataFrame, live: DataFrame, kb: str = "name") -> DataFrame:
    """Catalogue rows with the counts of the chunks there are, 0 for none, instead of stored ones."""
    n = live.select(F.col("kb_name").alias(kb), F.col("papers").alias("_p"), F.col("chunks").alias("_c"))
    return (
        meta.join(n, kb, "left")
        .withColumn("paper_count", F.coalesce("_p", F.lit(0)))
        .withColumn("chunk_count", F.coalesce("_c", F.lit(0)))
        .drop("_p", "_c")
    )


def merged_metadata(chunks: DataFrame, paper: str, order: str, filled: list[str], numbers: list[str] | None = None) -> DataFrame:
    """One row per paper: the first value in order that is not empty (``filled``) or not null (``numbers``)."""
    first = lambda c, some: F.min_by(F.when(some, F.col(c)), F.when(some, F.col(order))).alias(c)
    aggs = [first(c, F.coalesce(F.col(c), F.lit("")) != "") for c in filled]
    aggs += [first(c, F.col(c).isNotNull()) for c in numbers or []]
    return chunks.groupBy(paper).agg(*aggs)


def page(chunks: DataFrame, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in order of the key, of 1 to 100 rows."""
    return chunks.orderBy(key).offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def searchable(papers: DataFrame) -> DataFrame:
    """Papers with some full text, or an abstract that says something."""
    full = F.trim(F.coalesce("full_text", F.lit(""))) != ""
    abstract = F.trim(F.coalesce("abstract", F.lit("")))
    return papers.where(full | ((abstract != "") & ~F.contains(F.lower(abstract), F.lit("no abstract available"))))


def valid_year(year: F.col, this_year: int):
    return year.isNull() | year.between(1800, this_year + 1)


def quarantined(papers: DataFrame, this_year: int) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with ``errors``)."""
    checks = [
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title is blank"),
        F.when(~valid_year(F.col("year"), this_year), "year is out of range"),
    ]
    marked = papers.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


class Store:
    """Tables of knowledge bases under one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _at(self, table: str, kb: str) -> str:
        return f"{self.root}/{table}/kb_name={kb}"

    def exists(self, kb: str, table: str = "chunks") -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._at(table, kb)))

    def names(self, table: str = "chunks") -> list[str]:
        fs, path = self._fs()
        base = path(f"{self.root}/{table}")
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(base)) if fs.exists(base) else []

    def replace(self, kb: str, df: DataFrame, table: str = "chunks") -> None:
        """Write all rows to a staging directory, then put it in place.

        The old rows are moved aside before and deleted after; a failure on the way puts them back.
        """
        fs, path = self._fs()
        stage = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            df.drop("kb_name").write.parquet(stage)
        except BaseException:
            fs.delete(path(stage), True)
            raise
        target = path(self._at(table, kb))
        fs.mkdirs(target.getParent())
        aside = path(stage + "-old")
        if fs.exists(target) and not fs.rename(target, aside):
            fs.delete(path(stage), True)
            raise OSError(f"{target} could not be moved")
        try:
            if not fs.rename(path(stage), target):
                raise OSError(f"{stage} could not be put in place")
        except BaseException:
            if fs.exists(aside):
                fs.rename(aside, target)
            fs.delete(path(stage), True)
            raise
        fs.delete(aside, True)

    def append(self, kb: str, df: DataFrame, table: str = "chunks") -> None:
        df.drop("kb_name").write.mode("append").parquet(self._at(table, kb))

    def read(self, kb: str | None = None, table: str = "chunks") -> DataFrame:
        """All rows, or those of one knowledge base by pruning its partition."""
        df = self.spark.read.parquet(f"{self.root}/{table}")
        return df if kb is None else df.where(F.col("kb_name") == kb)

    def drop(self, kb: str, table: str = "chunks") -> bool:
        fs, path = self._fs()
        return fs.delete(path(self._at(table, kb)), True)

    def delete_ids(self, kb: str, gone: DataFrame, key: str = "id", table: str = "chunks") -> None:
        self.replace(kb, without(self.read(kb, table), gone, key), table)


def first_seen(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The first row of each key in order; without one, the least row as JSON, which is the same in every run."""
    w = Window.partitionBy(*keys).orderBy(order if order else F.to_json(F.struct(*df.columns)))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
