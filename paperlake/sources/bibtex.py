"""BibTeX: a scan of files, a column parser and the mapping of entries to papers.

A damaged entry is skipped to the next ``@`` at a line's start; entries
without a key keep an empty one; rows that are no papers are filtered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from paperlake import schemas
from paperlake.functions import ids

# Entry types that are papers.
PAPER_TYPES = ["article", "inproceedings", "misc", "book", "inbook", "phdthesis", "mastersthesis", "techreport"]
# Fields with columns of their own.
COLUMNS = ["title", "author", "abstract", "year", "journal", "journaltitle", "doi", "pmid", "url", "file", "keywords"]
ENTRY_TYPE = StructType(
    [StructField("entry_type", StringType()), StructField("key", StringType()), StructField("fields", MapType(StringType(), StringType()))]
)


def _value(text: str, i: int) -> tuple[str, int]:
    """The value that begins at ``i`` and where it ends: braces, quotes, bare words, joined by ``#``."""
    out = ""
    while i < len(text):
        while i < len(text) and text[i].isspace():
            i += 1
        if i < len(text) and text[i] in '{"':
            close, depth, start = ("}", 0, i) if text[i] == "{" else ('"', 0, i)
            i += 1
            while i < len(text) and not (text[i] == close and depth == 0):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1 + (text[i] == "\\")
            if i >= len(text):
                raise ValueError("open value")
            out += text[start + 1 : i]
            i += 1
        else:
            m = re.compile(r"[^\s,#}{\"]*").match(text, i)
            out += m[0]
            i = m.end()
        rest = re.compile(r"\s*#").match(text, i)
        if not rest:
            return re.sub(r"\s+", " ", out).strip(), i
        i = rest.end()
    return out, i


def parse(text: str | None) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; field names in lower case."""
    head = re.compile(r"@(\w+)\s*[{(]\s*([^,\s{}()]*)\s*,", re.M)
    field = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*")
    at = 0
    while m := head.search(text or "", at):
        at = m.end()
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        fields: dict[str, str] = {}
        i = at
        try:
            while f := field.match(text, i):
                value, i = _value(text, f.end())
                fields[f[1].lower()] = value
            at = i
        except ValueError:
            continue
        yield m[1].lower(), m[2], fields


@F.pandas_udf(ArrayType(ENTRY_TYPE))
def _entries(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"entry_type": a, "key": b, "fields": c} for a, b, c in parse(t)])


def entries(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """ENTRY rows of the BibTeX in a column, with the columns ``keep``."""
    return df.select(*keep, F.explode(_entries(F.col(text))).alias("e")).select(*keep, "e.*")


class BibtexSource(DataSource):
    """``spark.read.format("bibtex").load(path)``: one partition per file, bytes that are no UTF-8 replaced."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return schemas.ENTRY

    def reader(self, schema) -> DataSourceReader:
        return BibtexReader(self.options)


class BibtexReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.bib")) if os.path.isdir(path) else glob.glob(path))
        return [InputPartition(f) for f in files]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            yield from parse(f.read())


def scan(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY rows of the files at ``path`` on any file system Spark reads."""
    raw = spark.read.text(path, wholetext=True)
    return entries(raw, "value")


def normalized(rows: DataFrame) -> DataFrame:
    """ENTRY rows with ``journaltitle``, ``date`` and the DOI brought to their usual fields."""
    f = F.transform_keys(F.map_filter("fields", lambda k, v: v.isNotNull() & ~F.lower(k).isin("id", "entrytype")), lambda k, _: F.lower(k))
    g = lambda k: F.try_element_at(f, F.lit(k))
    date = F.left(g("date"), F.lit(4))
    extra = F.map_filter(
        F.create_map(
            F.lit("journal"), F.coalesce(g("journal"), g("journaltitle")),
            F.lit("year"), F.coalesce(g("year"), F.when(date.rlike("^[0-9]{4}$"), date)),
            F.lit("doi"), ids.doi_bibtex(g("doi")),
        ),
        lambda _, v: v.isNotNull(),
    )
    rest = F.map_filter(f, lambda k, _: ~k.isin("journal", "year", "doi", "journaltitle", "date"))
    return rows.withColumn("fields", F.map_concat(rest, extra))


def _authors(x: Column, between: str = " and ") -> Column:
    def one(a: Column) -> Column:
        comma = F.instr(a, ",") > 0
        family = F.when(comma, F.trim(F.substring_index(a, ",", 1))).otherwise(F.nullif(F.regexp_extract(a, r"^.* (\S+)$", 1), F.lit("")))
        after = F.trim(F.regexp_extract(a, r"^[^,]*,(.*)$", 1))
        given = F.when(comma, F.nullif(after, F.lit(""))).otherwise(F.nullif(F.regexp_extract(a, r"^(.*) \S+$", 1), F.lit("")))
        name = F.when(comma, F.concat_ws(" ", given, family)).otherwise(a)
        none = F.lit(None).cast("string")
        return F.struct(name.alias("name"), given.alias("given"), family.alias("family"), none.alias("orcid"))

    parts = F.filter(F.transform(F.split(x, between), F.trim), lambda a: a != "")
    return F.coalesce(F.transform(parts, one), F.array().cast(f"array<{schemas.AUTHOR}>"))


def papers(rows: DataFrame) -> DataFrame:
    """PAPER rows of normalized entries of the paper types with a title."""
    g = lambda k: F.try_element_at("fields", F.lit(k))
    title = F.regexp_replace(g("title"), "[{}]", "")
    keywords = F.when(F.coalesce(g("keywords"), F.lit("")) != "", F.split(g("keywords"), ", ")).otherwise(F.array().cast("array<string>"))
    kept = rows.where(F.col("entry_type").isin(PAPER_TYPES) & (F.trim(F.coalesce(title, F.lit(""))) != ""))
    null = F.lit(None)
    return kept.select(
        ids.paper_id(g("doi"), g("pmid"), title).alias("id"), title.alias("title"), _authors(g("author")).alias("authors"),
        g("abstract").alias("abstract"), g("year").try_cast("int").alias("year"), g("journal").alias("journal"), g("doi").alias("doi"),
        g("pmid").alias("pmid"), g("url").alias("url"), g("file").alias("pdf_url"), null.cast("int").alias("citation_count"),
        F.lit("bibtex").alias("source"), keywords.alias("keywords"), null.cast("string").alias("full_text"),
        F.map_filter("fields", lambda k, _: ~k.isin(COLUMNS)).alias("metadata"),
    )


def local_pdf(x: Column) -> Column:
    """The part of a reference manager's ``file`` field that ends in .pdf; null if none."""
    bare = F.regexp_replace(F.trim(x), r"^\{|\}$", "")
    part = F.filter(F.transform(F.split(bare, ":"), F.trim), lambda p: F.lower(p).endswith(".pdf"))
    return F.try_element_at(part, F.lit(1))
