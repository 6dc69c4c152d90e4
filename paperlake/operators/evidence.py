"""Evidence of a question: duplicates, facets, confidence, citations.

Defined results: an empty DOI, title or id counts as missing; a facet without
entries is a gap of confidence 0; ties go to the smaller position.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperlake.functions import ids, text


def dedupe_key(title: Column, doi: Column, id_: Column) -> Column:
    """Title fingerprint of 40 characters or more, else DOI, else id, else a short fingerprint; null if all are missing."""
    fp = text.fingerprint(F.coalesce(title, F.lit("")))
    d = ids.doi_key(doi)
    i = F.trim(F.coalesce(id_, F.lit("")))
    return (
        F.when(F.length(fp) >= 40, F.concat(F.lit("title:"), fp))
        .when(d != "", F.concat(F.lit("doi:"), d))
        .when(i != "", F.concat(F.lit("oa:"), i))
        .when(fp != "", F.concat(F.lit("title:"), fp))
    )


def keep_best(papers: DataFrame, pos: str) -> DataFrame:
    """One row per key, the one with most text, abstract, citations, the newest, not from a preprint server; adds ``first_pos``.

    papers: title, doi, id, full_text, abstract, citation_count, year and
    ``pos``. Rows that have nothing to be known by are dropped unless titled.
    The best row is found by an aggregate over positions, so long texts are
    moved only once.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    quality = F.struct(
        size("full_text").alias("a"), size("abstract").alias("b"), F.coalesce("citation_count", F.lit(0)).alias("c"),
        F.coalesce("year", F.lit(0)).alias("d"), (~ids.doi_key(F.col("doi")).startswith("10.1101")).cast("int").alias("e"),
        (-F.col(pos)).alias("f"),
    )
    key = F.coalesce(dedupe_key(F.col("title"), F.col("doi"), F.col("id")), F.when(F.col("title") != "", F.concat(F.lit("unknown:"), pos)))
    small = papers.select(key.alias("k"), quality.alias("q"), F.col(pos).alias("p")).where("k IS NOT NULL")
    best = small.groupBy("k").agg((-F.max("q")["f"]).alias("_best"), F.min("p").alias("first_pos"))
    return papers.join(best, F.col(pos) == F.col("_best")).drop("_best", "k")


def source_list(hits: DataFrame, group: str, order: str, most: int = 10, by: str = "title") -> DataFrame:
    """The first ``most`` sources of each group in order, one per title (or DOI where there is one); adds ``place``."""
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.col("doi")).otherwise(F.col("title")) if by == "doi" else F.col("title")
    one = Window.partitionBy(group, key).orderBy(order)
    place = Window.partitionBy(group).orderBy(order)
    first = hits.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def evidence_key(doi: Column, title: Column) -> Column:
    d, t = F.lower(F.trim(F.coalesce(doi, F.lit("")))), F.left(F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit(120))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t)).otherwise("")


def facet_key(q: Column) -> Column:
    return F.when(F.trim(F.coalesce(q, F.lit(""))) == "", "main").otherwise(F.left(F.lower(q), F.lit(120)))


def accumulated(entries: DataFrame, facet: str, pos: str) -> DataFrame:
    """The first entry of each key within a facet; entries without a key are all kept."""
    k = evidence_key(F.col("doi"), F.col("title"))
    keyed = entries.withColumn("_k", F.when(k == "", F.concat(F.lit("#"), F.col(pos).cast("string"))).otherwise(k))
    w = Window.partitionBy(facet, "_k").orderBy(pos)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")


def facets(names: DataFrame, entries: DataFrame, facet: str) -> DataFrame:
    """facet, n, status, confidence of every facet in ``names``; entries have relevance and full_text (boolean)."""
    n = entries.groupBy(facet).agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce("relevance", F.lit(3))).alias("r"),
        F.avg(F.coalesce(F.col("full_text"), F.lit(False)).cast("int")).alias("f"),
    )
    both = names.join(n, facet, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "gap").when(F.col("n") <= 2, "partial").otherwise("covered")
    rel = F.least(F.greatest((F.col("r") - 1) / 4, F.lit(0.0)), F.lit(1.0))
    score = F.round(0.45 * F.least(F.col("n") / 5, F.lit(1.0)) + 0.35 * rel + 0.20 * F.col("f"), 4)
    return both.select(facet, "n", status.alias("status"), F.when(F.col("n") == 0, 0.0).otherwise(score).alias("confidence"))


def overall(facet_rows: DataFrame, facet: str = "facet", group: str | None = None) -> DataFrame:
    """One row (per ``group``): the mean confidence, the number of gaps, and the maps of statuses and confidences by facet.

    The facets of one plan are one row; rows of many plans need their ``group``.
    """
    by = lambda c: F.map_from_entries(F.collect_list(F.struct(facet, c)))
    return facet_rows.groupBy(*([group] if group else [])).agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count_if(F.col("status") == "gap").alias("gaps"),
        by("status").alias("statuses"), by("confidence").alias("confidences"),
    )


def prompt_block(facet_rows: DataFrame, entries: DataFrame, facet: str, pos: str, most: int = 7, chars: int = 3200, group: str | None = None) -> DataFrame:
    """(group,) block: each facet's status and latest entries as lines for a model, cut at ``chars`` characters.

    entries: title, doi, excerpt. Facets come in the order of ``ord`` if there is one, else by name.
    """
    some = lambda c, *x: F.when(F.coalesce(c, F.lit("")) != "", F.concat(*x)).otherwise("")
    line = F.concat(
        F.lit("  - "), F.left(F.coalesce("title", F.lit("?")), F.lit(140)), some(F.col("doi"), F.lit(" (DOI: "), "doi", F.lit(")")),
        some(F.col("excerpt"), F.lit("\n    "), F.left("excerpt", F.lit(350))),
    )
    last = last_entries(entries, facet, pos, most).groupBy(facet).agg(F.array_sort(F.collect_list(F.struct(pos, line.alias("l")))).alias("_e"))
    rows = facet_rows.join(last, facet, "left")
    head = F.concat(F.lit("["), F.upper("status"), F.lit("] Facet: "), facet)
    lines = F.array_join(F.transform("_e", lambda e: e["l"]), "\n")
    section = F.concat(head, F.lit("\n"), F.coalesce(lines, F.lit("  (no evidence yet)")))
    order = F.col("ord" if "ord" in facet_rows.columns else facet)
    all_ = rows.groupBy(*([group] if group else [])).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s")))).alias("_s"))
    text_ = F.array_join(F.transform("_s", lambda x: x["s"]), "\n\n")
    return all_.select(*([group] if group else []), F.when(F.length(text_) > chars, F.concat(F.left(text_, F.lit(chars)), F.lit("\n…"))).otherwise(text_).alias("block"))


def last_entries(entries: DataFrame, facet: str, pos: str, most: int = 7) -> DataFrame:
    """The ``most`` latest entries of each facet."""
    w = Window.partitionBy(facet).orderBy(F.col(pos).desc())
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def recent_found(papers: DataFrame, pos: str, limit: int) -> DataFrame:
    """The first ``limit`` titles (100 characters) among the last ``2 * limit`` papers."""
    last = papers.orderBy(F.col(pos).desc()).limit(2 * limit)
    key = F.left(F.lower(F.coalesce("title", F.lit(""))), F.lit(100))
    one = last.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_n = 1").drop("_n")
    return one.orderBy(pos).limit(limit)


def relevant(papers: DataFrame, scores: DataFrame, key: str, least: int) -> DataFrame:
    """Papers with a score of ``least`` or more; those of the knowledge base are kept with at least that score."""
    both = papers.join(scores.select(key, "score"), key, "left")
    kb = F.col("from_kb")
    out = F.when(kb, F.greatest(F.coalesce("score", F.lit(least)), F.lit(least))).otherwise(F.col("score"))
    return both.withColumn("score", out).where(F.col("score") >= least)


def citation_check(answer: Column, papers: Column) -> Column:
    """Struct cited, uncited, invalid (arrays of numbers), total, cited_count for an answer over ``papers`` papers."""
    found = text.cited(answer)
    valid = F.when(papers > 0, F.sequence(F.lit(1), papers)).otherwise(F.array().cast("array<int>"))
    cited = F.array_sort(F.array_intersect(found, valid))
    return F.struct(
        cited.alias("cited"), F.array_except(valid, found).alias("uncited"), F.array_sort(F.array_except(found, valid)).alias("invalid"),
        papers.alias("total"), F.size(cited).alias("cited_count"),
    )


_MARK = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")


def verified_text(answer: str | None, papers: int) -> str | None:
    """An answer without citations of papers that are not there."""
    if not answer:
        return answer
    bad = False

    def keep(m: re.Match) -> str:
        nonlocal bad
        numbers = [int(x) for x in m[1].split(",")]
        fine = [n for n in numbers if 1 <= n <= papers]
        bad = bad or len(fine) < len(numbers)
        return f"[{', '.join(map(str, fine))}]" if fine else ""

    out = _MARK.sub(keep, answer)
    return re.sub("  +", " ", out) if bad else answer


def compact_text(answer: str | None, cited: list[int] | None) -> str | None:
    """Citations renumbered to the places of the cited papers in order."""
    if not answer:
        return answer
    place = {n: i for i, n in enumerate(sorted(cited if cited is not None else []), 1)}
    return _MARK.sub(lambda m: f"[{', '.join(str(place.get(int(x), int(x))) for x in m[1].split(','))}]", answer)


@F.pandas_udf(StringType())
def _verified(a: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([verified_text(x, int(k)) for x, k in zip(a, n)])


@F.pandas_udf(StringType())
def _compact(a: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([compact_text(x, None if k is None else list(k)) for x, k in zip(a, n)])


def verified(answer: Column, papers: Column) -> Column:
    return _verified(answer, papers)


def compacted(answer: Column, cited: Column) -> Column:
    return _compact(answer, cited)


def neighbours_missing(facet_rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Gaps that no remaining step (query) covers."""
    gaps = facet_rows.where("status = 'gap'")
    return gaps.join(steps.select(facet_key(F.col("query")).alias("facet")).distinct(), "facet", "left_anti")


def citation_list(hits: DataFrame, group: str) -> DataFrame:
    """group, url, citation, documents, date of each distinct source; ``date`` is that of the first in order. hits: url, citation, date, pos."""
    c = hits.select(group, F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.nullif("citation", F.lit("")), F.lit("Unknown")).alias("citation"), "date", "pos")
    return c.groupBy(group, "url", "citation").agg(F.count("*").alias("documents"), F.min_by("date", "pos").alias("date"))


def web_results(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """key, pos, content, citation, url of web results given as a JSON list, object, ``{"results": …}`` or plain text.

    Null, blank and empty results give no rows; malformed JSON is plain text.
    """
    item = "content string, text string, snippet string, body string, citation string, title string, url string"
    t = F.trim(F.col(raw))
    listed = F.from_json(t, f"array<struct<{item.replace(' string', ':string')}>>")
    nested = F.from_json(t, f"results array<struct<{item.replace(' string', ':string')}>>")["results"]
    single = F.from_json(t, item)
    some = lambda s, *names: F.coalesce(*[F.nullif(s[n], F.lit("")) for n in names])
    is_json = t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull()
    rows = F.when(is_json & t.startswith("["), listed).when(is_json, F.coalesce(nested, F.array(single)))
    shaped = F.transform(
        rows,
        lambda s: F.struct(
            some(s, "content", "text", "snippet", "body").alias("content"),
            F.coalesce(some(s, "citation", "title"), F.lit("Web search")).alias("citation"),
            F.coalesce(s["url"], F.lit("")).alias("url"),
        ),
    )
    text_only = F.array(F.struct(t.alias("content"), F.lit("Web search").alias("citation"), F.lit("").alias("url")))
    flat = answers.where(t != "").select(key, F.posexplode(F.when(is_json, shaped).otherwise(text_only)).alias("pos", "r"))
    return flat.select(key, "pos", "r.*").where("content IS NOT NULL")


def bypassing(hits: DataFrame, group: str, order: str, web: Column, most: int) -> DataFrame:
    """``source_list`` in which rows marked ``web`` are never duplicates."""
    key = F.when(web, F.concat(F.lit("#"), F.col(order).cast("string"))).otherwise(F.col("title"))
    w, v = Window.partitionBy(group, "_k").orderBy(order), Window.partitionBy(group).orderBy(order)
    first = hits.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")
    return first.withColumn("place", F.row_number().over(v)).where(F.col("place") <= most)


def to_fetch(papers: DataFrame, pos: str, least: int, most: int) -> DataFrame:
    """The first ``most`` papers of at least that relevance whose text is to be fetched."""
    return papers.where(F.col("relevance") >= least).orderBy(pos).limit(most)


def reported(papers: DataFrame, least: int = 3) -> DataFrame:
    """Found papers worth showing: of that relevance, and not from the knowledge base."""
    return papers.where((F.col("relevance") >= least) & (F.col("source") != "kb_search"))


def for_extraction(papers: DataFrame, pos: str, most: int = 8) -> DataFrame:
    """The first papers with a full text of 500 or an abstract of 200 characters, body of 400 or more; ``place`` keeps the input's."""
    full, abstract = F.coalesce("full_text", F.lit("")), F.coalesce("abstract", F.lit(""))
    body = F.when(F.length(full) >= 500, full).otherwise(abstract)
    fits = (F.length(full) >= 500) | (F.length(abstract) >= 200)
    first = papers.where(fits).orderBy(pos).limit(most).withColumn("body", body).where(F.length("body") >= 400)
    if "place" in papers.columns:
        return first
    # at most ``most`` rows, each against the positions of all: a sum per row, combined before the shuffle
    bounds = first.select(F.col(pos).alias("_at"))
    place = papers.select(F.col(pos).alias("_p")).join(F.broadcast(bounds), F.col("_p") <= F.col("_at")).groupBy("_at").agg(F.count("*").alias("place"))
    return first.join(place, F.col(pos) == F.col("_at")).drop("_at")


def download_order(papers: DataFrame, pos: str, least: int = 3, most: int = 10) -> DataFrame:
    """The first ``most`` papers with a DOI and a relevance of ``least``, with ``place``: closed access first, then by relevance.

    The order is the one of a descending sort by (not open access, relevance), ties in the order of ``pos``.
    """
    some = papers.where((F.coalesce("relevance", F.lit(0)) >= least) & (F.coalesce("doi", F.lit("")) != "")).orderBy(pos).limit(most)
    w = Window.orderBy((~F.coalesce("open_access", F.lit(False))).desc(), F.coalesce("relevance", F.lit(0)).desc(), pos)  # at most ``most`` rows
    return some.withColumn("place", F.row_number().over(w))


def across_sources(found: DataFrame, pos: str) -> DataFrame:
    """Results of several services without repeats: of equal DOIs, or titles where there is none, the best cited, then the first."""
    k = evidence_key(F.col("doi"), F.col("title"))
    keyed = found.withColumn("_k", F.when(k == "", F.concat(F.lit("#"), F.col(pos).cast("string"))).otherwise(k))
    w = Window.partitionBy("_k").orderBy(F.coalesce("citations", F.lit(0)).desc(), pos)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")


def accuracy(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """One row: rows and the share predicted right."""
    return df.agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(expected)).cast("double")).alias("accuracy"))


def outcomes(df: DataFrame, outcome: str, kinds: list[str]) -> DataFrame:
    """One row: rows attempted and the number of each outcome."""
    return df.agg(F.count("*").alias("attempted"), *[F.count_if(F.col(outcome) == k).alias(k) for k in kinds])
