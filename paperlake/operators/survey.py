"""Literature surveys: candidates, themes, recommendations and their counts.

papers: pid, year, citations, relevance (may be null), pos (input order);
themes: pid, theme. Ties keep the input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(papers: DataFrame) -> DataFrame:
    """Papers that have an abstract."""
    return papers.where(F.trim(F.coalesce("abstract", F.lit(""))) != "")


def relevant(papers: DataFrame, least: float = 1.5) -> DataFrame:
    """Scores below 1 count as 2; papers of ``least`` or more, all of them if there is none."""
    scored = papers.withColumn("relevance", F.when(F.coalesce("relevance", F.lit(0.0)) < 1, 2.0).otherwise(F.col("relevance")))
    any_ = scored.agg(F.coalesce(F.max(F.col("relevance") >= least), F.lit(False)).alias("_any"))
    return scored.join(F.broadcast(any_)).where((F.col("relevance") >= least) | ~F.col("_any")).drop("_any")


def themes_of(papers: DataFrame, assigned: DataFrame, names: DataFrame) -> DataFrame:
    """pid, theme of assignments to an existing theme by its exact name."""
    return assigned.join(names.select("theme"), "theme", "left_semi").join(papers.select("pid"), "pid", "left_semi").distinct()


def theme_counts(names: DataFrame, assigned: DataFrame) -> DataFrame:
    n = assigned.groupBy("theme").agg(F.countDistinct("pid").alias("papers"))
    return names.join(n, "theme", "left").select("theme", F.coalesce("papers", F.lit(0)).alias("papers"))


def top_per_theme(papers: DataFrame, assigned: DataFrame) -> DataFrame:
    """theme, pid, citations: the most cited paper of each theme."""
    both = assigned.join(papers.select("pid", "citations", "pos"), "pid")
    best = both.groupBy("theme").agg(F.max(F.struct(F.coalesce("citations", F.lit(0)).alias("c"), (-F.col("pos")).alias("n"), "pid")).alias("b"))
    return best.select("theme", F.col("b.pid").alias("pid"), F.col("b.c").alias("citations"))


def recommended(papers: DataFrame, assigned: DataFrame, as_of_year: int, most: int = 50, recent: int = 5) -> DataFrame:
    """pid, reason, place: the most cited of each theme, the ``recent`` best of the last three years, then by relevance and citations."""
    p = relevant(papers)
    top = top_per_theme(p, assigned.join(p.select("pid"), "pid", "left_semi"))
    first = top.groupBy("pid").agg(F.min("theme").alias("theme"))
    rest = p.join(first.select("pid"), "pid", "left_anti")
    new = rest.where(F.col("year") >= as_of_year - 3).orderBy(F.col("relevance").desc(), "pos").limit(recent)
    tail = rest.join(new.select("pid"), "pid", "left_anti")
    by_score = Window.orderBy(F.col("relevance").desc(), F.coalesce("citations", F.lit(0)).desc(), "pos")
    third = tail.orderBy(F.col("relevance").desc(), F.coalesce("citations", F.lit(0)).desc(), "pos").limit(most)
    parts = (
        first.select("pid", F.concat(F.lit("Highly cited in theme: "), "theme").alias("reason"), F.lit(1).alias("tier"), F.row_number().over(Window.orderBy("theme")).alias("o"))
        .unionByName(new.select("pid", F.lit("Recent advance in the field").alias("reason"), F.lit(2).alias("tier"), F.row_number().over(Window.orderBy(F.col("relevance").desc(), "pos")).alias("o")))
        .unionByName(third.select("pid", F.lit("Highly relevant to the topic").alias("reason"), F.lit(3).alias("tier"), F.row_number().over(by_score).alias("o")))
    )
    # themes and the limits above bound these rows
    placed = parts.withColumn("place", F.row_number().over(Window.orderBy("tier", "o")))
    return placed.where((F.col("tier") < 3) | (F.col("place") <= most)).select("pid", "reason", "place")


def concepts(analyses: DataFrame) -> DataFrame:
    """Distinct concepts of all analyses (array column ``concepts``)."""
    return analyses.select(F.explode("concepts").alias("concept")).where(F.trim("concept") != "").distinct()


def default_themes(spark, question: str, analyses: DataFrame) -> DataFrame:
    """Themes where a model found none: three without analyses, two without concepts, no rows otherwise."""
    none = [f"{question.title()} Research", "Methods and Approaches", "Applications"]
    bare = [f"{question.title()} Research", "Related Topics"]
    names = none if analyses.isEmpty() else bare if concepts(analyses).isEmpty() else []
    return spark.createDataFrame([(n,) for n in names], "theme string")


def assigned_or_first(papers: DataFrame, assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Assignments, or all papers to the first theme (``ord``) where there is none."""
    any_ = assigned.agg((F.count("*") > 0).alias("_any"))
    first = names.orderBy("ord").limit(1).select("theme")
    rest = papers.select("pid").join(F.broadcast(first)).join(F.broadcast(any_)).where("NOT _any")
    return assigned.select("pid", "theme").unionByName(rest.select("pid", "theme"))


def report_lines(picked: DataFrame, order: str) -> DataFrame:
    """One row: a numbered list of the picked papers (title, authors, year, doi)."""
    from paperlake.functions.text import reference_line

    c = F.col
    line = reference_line(c(order), c("title"), c("authors"), c("year"), c("doi"))
    # a report has the survey's number of papers at most
    return picked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("report"))
