"""Records of scholarly services mapped to the engine's rows, and the choice of the best content.

Everything here works on rows that a connector brought or a file holds; no
function calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import ids

WORK = (
    "title string, type string, doi string, open_access struct<is_oa:boolean,oa_url:string>, ids struct<pmcid:string,doi:string,arxiv:string>, "
    "abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, publication_year int, "
    "cited_by_count int, locations array<struct<pdf_url:string>>, best_oa_location struct<pdf_url:string>, primary_location struct<pdf_url:string>"
)
UNPAYWALL = "is_oa boolean, best_oa_location struct<url_for_pdf:string,url:string>, oa_locations array<struct<url:string,url_for_landing_page:string>>"
SCHOLAR = (
    "paperId string, title string, abstract string, authors array<struct<authorId:string,name:string>>, year int, "
    "externalIds struct<DOI:string,ArXiv:string,PubMed:string,CorpusId:string>, citationCount int, venue string, openAccessPdf struct<url:string>, url string"
)
# Where content comes from, the best first, and what kind it is.
CONTENT_ORDER = [
    ("alternative", "full_text"), ("pmc", "structured"), ("arxiv_html", "structured"), ("publisher_oa_pdf", "full_text"), ("arxiv_pdf", "full_text"),
    ("unpaywall_pdf", "full_text"), ("openalex_oa_pdf", "full_text"), ("acs_pdf", "full_text"), ("rsc_pdf", "full_text"), ("aaas_pdf", "full_text"),
    ("springer_pdf", "full_text"), ("wiley_pdf", "full_text"), ("wiley_tdm_pdf", "full_text"), ("elsevier_xml", "full_text"), ("abstract", "abstract"),
]
FULL_TEXT_CHARS, ABSTRACT_CHARS = 200, 20


def inverted_abstract(index: Column) -> Column:
    """Text of a map from words to positions, the words in order; null for an empty map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def inverted_abstract_gaps(index: Column) -> Column:
    """The same with an empty word for each position that is missing."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = F.array_max(F.transform(pairs, lambda x: x["p"]))
    at = F.map_from_entries(F.array_distinct(pairs))
    return F.when(last.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(""))), " "))


def words_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, index: the map of ``inverted_abstract``, the positions of each word of a text."""
    w = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    at = docs.select(key, F.posexplode(w).alias("p", "w")).groupBy(key, "w").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return at.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("index"))


def pmcid_of(locations: Column) -> Column:
    """The first PMC number in the addresses of open-access locations."""
    found = F.transform(locations, lambda x: F.regexp_extract(F.coalesce(F.nullif(x["url"], F.lit("")), x["url_for_landing_page"], F.lit("")), r"(PMC\d+)", 1))
    return F.try_element_at(F.filter(found, lambda p: p != ""), F.lit(1))


def discovery(raw: DataFrame) -> DataFrame:
    """DISCOVERY rows of doi, work (JSON of a work) and unpaywall (JSON); the second fills only what the first lacks."""
    r = raw.select("doi", F.from_json("work", WORK).alias("w"), F.from_json("unpaywall", UNPAYWALL).alias("u"))
    some = lambda c: F.nullif(c, F.lit(""))
    arxiv = F.coalesce(some(F.regexp_extract("w.ids.arxiv", r"([^/]+)$", 1)), ids.arxiv_of_doi(F.coalesce("w.doi", "doi")))
    best = F.coalesce(some(F.col("u.best_oa_location.url_for_pdf")), F.col("u.best_oa_location.url"))
    pmcid = F.regexp_extract(F.coalesce("w.ids.pmcid", F.lit("")), r"(PMC\d+)", 1)
    return r.select(
        "doi", F.col("w.title").alias("title"), F.coalesce("w.open_access.is_oa", "u.is_oa", F.lit(False)).alias("is_oa"),
        F.coalesce(some(F.col("w.open_access.oa_url")), F.col("u.best_oa_location.url")).alias("oa_url"),
        F.coalesce(some(pmcid), pmcid_of(F.col("u.oa_locations"))).alias("pmcid"), arxiv.alias("arxiv_id"),
        inverted_abstract(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.filter(F.transform("w.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        F.col("w.publication_year").alias("year"), best.alias("unpaywall_pdf_url"),
    )


def pdf_candidates(work: Column) -> Column:
    """Distinct web addresses of a work's PDF files in order: locations, best, primary, open access."""
    urls = F.concat(
        F.coalesce(F.transform(work["locations"], lambda x: x["pdf_url"]), F.array().cast("array<string>")),
        F.array(work["best_oa_location"]["pdf_url"], work["primary_location"]["pdf_url"], work["open_access"]["oa_url"]),
    )
    return F.array_distinct(F.filter(urls, lambda u: u.startswith("http")))


def cached(dois: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache for these DOIs, DOIs still to ask for); compared in lower case."""
    want = dois.select("doi", F.lower("doi").alias("_k")).distinct()
    have = cache.withColumn("_k", F.lower("doi")).drop("doi")
    return want.join(have, "_k").drop("_k"), want.join(have.select("_k").distinct(), "_k", "left_anti").drop("_k")


def zotero_papers(records: DataFrame) -> DataFrame:
    """Paper rows of records in the Zotero-like format (title, author, date_text, doi, publication_title, abstract_note, url, citation_count)."""
    from paperlake.sources.bibtex import _authors

    some = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.coalesce(some("title"), F.lit("Untitled"))
    authors = _authors(F.coalesce("author", F.lit("")), r"\s*;\s*")  # "and" may be part of an organisation's name
    null = F.lit(None).cast("string")
    return records.select(
        "record_no", ids.paper_id(F.col("doi"), null, title, F.col("url")).alias("id"), title.alias("title"), authors.alias("authors"),
        some("abstract_note").alias("abstract"), F.regexp_extract(F.coalesce("date_text", F.lit("")), r"^(\d{1,6})(?:-|$)", 1).try_cast("int").alias("year"),
        some("publication_title").alias("journal"), some("doi").alias("doi"), some("url").alias("url"),
        F.when(F.col("citation_count") != 0, F.col("citation_count")).alias("citation_count"), F.lit("scilex").alias("source"),
        F.create_map(F.lit("archive"), F.coalesce("api_source", F.lit("unknown"))).alias("metadata"),
    )


def scholar_papers(raw: DataFrame) -> DataFrame:
    """Paper rows of a scholarly graph's JSON (column ``json``); rows without an id are left out."""
    p = raw.select(F.from_json("json", SCHOLAR).alias("p")).select("p.*").where("paperId IS NOT NULL OR externalIds.DOI IS NOT NULL")
    return p.select(
        F.coalesce(F.concat(F.lit("doi:"), F.lower("externalIds.DOI")), "paperId").alias("id"), "title", "abstract",
        F.transform("authors", lambda a: a["name"]).alias("authors"), "year", F.col("externalIds.DOI").alias("doi"),
        F.col("externalIds.PubMed").alias("pmid"), F.col("citationCount").alias("citation_count"), F.nullif("venue", F.lit("")).alias("journal"),
        F.col("openAccessPdf.url").alias("pdf_url"), "url",
    )


def by_type(records: DataFrame, kind: str, type_col: str, title: str, journal: str) -> DataFrame:
    """Records whose type holds ``kind``; reviews also need the word in title or journal."""
    fits = F.contains(F.lower(F.coalesce(type_col, F.lit(""))), F.lit(kind))
    if kind == "review":
        text = F.lower(F.concat_ws(" ", title, journal))
        fits = fits & (F.contains(text, F.lit("review")) | F.contains(text, F.lit("survey")))
    return records.where(fits)


def year_range(low: int | None, high: int | None, this_year: int) -> tuple[int, int]:
    """Years to search: both ends, one end and this year or the first, else the last three years."""
    if low is None and high is None:
        return this_year - 3, this_year
    return low if low is not None else 1800, high if high is not None else this_year


def pdf_bytes_ok(content: Column) -> Column:
    """1,000 bytes or more that begin like a PDF or are UTF-8 text."""
    text = F.try_validate_utf8(content.cast("string")).isNotNull()
    return (F.length(content) >= 1000) & (content.startswith(F.lit(b"%PDF")) | text)


def best_content(candidates: DataFrame) -> DataFrame:
    """doi, source, content_type, text: the best usable content of each DOI, ``none`` where there is none.

    candidates: doi, source (of CONTENT_ORDER), text. Full text needs more
    than 200 characters, an abstract more than 20.
    """
    rank = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(CONTENT_ORDER) for x in (s, i)])
    kind = F.create_map(*[F.lit(x) for s, k in CONTENT_ORDER for x in (s, k)])
    r = F.try_element_at(rank, F.col("source"))
    least = F.when(F.col("source") == "abstract", ABSTRACT_CHARS).otherwise(FULL_TEXT_CHARS)
    ok = r.isNotNull() & (F.length(F.trim("text")) > least)
    best = candidates.groupBy("doi").agg(F.min(F.when(ok, F.struct(r.alias("r"), F.col("source").alias("s"), F.col("text").alias("t")))).alias("b"))
    return best.select(
        "doi", F.col("b.s").alias("source"), F.coalesce(F.try_element_at(kind, F.col("b.s")), F.lit("none")).alias("content_type"), F.col("b.t").alias("text")
    )


def first_provider(results: DataFrame, group: str, priority: str) -> DataFrame:
    """Rows of the first provider in order that found anything, per request."""
    w = Window.partitionBy(group)
    return results.withColumn("_p", F.min(priority).over(w)).where(F.col(priority) == F.col("_p")).drop("_p")


CROSSREF = (
    "title array<string>, DOI string, URL string, author array<struct<given:string,family:string>>, `container-title` array<string>, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int"
)


def crossref_papers(raw: DataFrame) -> DataFrame:
    """Paper rows of a DOI registry's messages (doi, json); rows that are no message are left out."""
    m = raw.select("doi", F.from_json("json", CROSSREF).alias("m")).where("m.title IS NOT NULL OR m.author IS NOT NULL")
    first = lambda c: F.try_element_at(c, F.lit(1))
    date = F.coalesce(F.col("m.published-print.date-parts"), F.col("m.published-online.date-parts"))
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    people = F.filter(F.transform("m.author", lambda a: F.struct(name(a).alias("name"), a["given"].alias("given"), a["family"].alias("family"))), lambda a: a["name"] != "")
    return m.select(
        F.concat(F.lit("doi:"), "doi").alias("id"), F.coalesce(first(F.col("m.title")), F.lit("Untitled")).alias("title"), people.alias("authors"),
        first(first(date)).alias("year"), first(F.col("m.container-title")).alias("journal"), "doi", F.col("m.URL").alias("url"),
        F.col("m.is-referenced-by-count").alias("citation_count"), F.lit("web_search").alias("source"),
    )


def pdf_chain(found: DataFrame, wiley_token: bool = False) -> DataFrame:
    """doi, priority, source, url: where to try for a PDF, in order. found: DISCOVERY rows and ``url``."""
    d = F.lower(ids.doi_plain(F.col("doi")))
    arxiv = F.coalesce(F.col("arxiv_id"), ids.arxiv_of_doi(d), ids.arxiv_of_url(F.col("url")))
    none = F.lit(None).cast("string")
    by_publisher = lambda name: ids.publisher(d) == name
    tries = [
        ("publisher_oa_pdf", F.col("oa_url").isNotNull(), F.col("oa_url")),
        ("arxiv_pdf", arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)),
        ("unpaywall_pdf", F.col("unpaywall_pdf_url").isNotNull(), F.col("unpaywall_pdf_url")),
        ("openalex_oa_pdf", F.lit(True), none),
        *[(f"{p.lower()}_pdf", by_publisher(p), none) for p in ("ACS", "RSC", "AAAS", "Springer", "Wiley")],
        ("wiley_tdm_pdf", F.lit(wiley_token), none),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(i).alias("priority"), F.lit(n).alias("source"), u.alias("url"))) for i, (n, c, u) in enumerate(tries)])
    return found.select("doi", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("t")).select("doi", "t.*")


def address_kind(x: Column) -> Column:
    """How an address in a question leads to a paper: struct (kind, id) of arxiv, doi or web; null without an address."""
    url = ids.url_in(x)
    doi = F.nullif(F.regexp_replace(F.regexp_extract(url, r"(10\.\d{4,9}/[^\s\])>'\"]+)", 1), r"[.,;)]+$", ""), F.lit(""))
    arxiv = ids.arxiv_of_url(url)
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("id"))
    return F.when(arxiv.isNotNull(), one("arxiv", arxiv)).when(doi.isNotNull(), one("doi", doi)).when(url.isNotNull(), one("web", url))


def existing_files(papers: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Papers whose ``path`` is in a file listing (column ``path``, as the binaryFile reader gives it)."""
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    have = listing.select(bare(F.col("path")).alias("_p")).distinct()
    return papers.join(have, bare(F.col(path)) == F.col("_p"), "left_semi")
