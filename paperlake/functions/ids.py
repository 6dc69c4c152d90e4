"""Identifiers of papers, chunks and knowledge bases as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI_PREFIX = r"^(?:https://doi\.org/|http://dx\.doi\.org/|doi:)\s*"
# Publishers by DOI prefix.
PUBLISHERS = {
    "10.1021": "ACS", "10.1039": "RSC", "10.1126": "AAAS", "10.1007": "Springer", "10.1038": "Springer", "10.1186": "Springer",
    "10.1002": "Wiley", "10.48550": "arXiv",
}


def doi_prefix_free(x: Column) -> Column:
    """Trimmed text without resolver prefixes, case kept."""
    return F.trim(F.regexp_replace(F.trim(x), "(?i)" + DOI_PREFIX, ""))


def doi(x: Column) -> Column:
    """DOI as used to match questions: lower case, no resolver, no closing punctuation; empty for null."""
    return F.regexp_replace(doi_key(x), r"[.,);]+$", "")


def doi_key(x: Column) -> Column:
    """DOI as used to remove duplicates: lower case, no resolver."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), DOI_PREFIX, ""))


def doi_bibtex(x: Column) -> Column:
    """DOI of a bibliography entry: no braces or resolver, case kept; null if nothing is left."""
    bare = F.trim(F.regexp_replace(x, r"[{}]", ""))
    free = F.regexp_replace(bare, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")
    return F.nullif(F.trim(free), F.lit(""))


def doi_plain(x: Column) -> Column:
    """DOI with two resolver prefixes removed wherever they stand."""
    return F.replace(F.replace(x, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))


def scholar_id(x: Column) -> Column:
    """Identifier for a scholarly graph service: known prefixes kept, DOI and arXiv ids prefixed."""
    s = F.trim(x)
    known = s.rlike(r"^(?:DOI:|ArXiv:|PMID:|CorpusId:|https://|http://)")
    arxiv = s.rlike(r"(?i)^\d{4}\.\d{4,5}(?:v\d+)?$") | s.rlike(r"(?i)^[a-z-]+/\d{7}$")
    return (
        F.when(known, s)
        .when(s.rlike(r"^10\.\d{4,9}/"), F.concat(F.lit("DOI:"), s))
        .when(arxiv, F.concat(F.lit("ArXiv:"), s))
        .otherwise(s)
    )


def arxiv_of_url(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)arxiv\.org/(?:abs|html|pdf|format)/(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit(""))


def arxiv_of_doi(x: Column) -> Column:
    """What follows the first ``arxiv.``, else the first ``arxiv:``, in lower case; null without either."""
    d = F.lower(x)
    dot, colon = F.instr(d, "arxiv."), F.instr(d, "arxiv:")
    at = F.when(dot > 0, dot).when(colon > 0, colon)
    return F.when(at.isNotNull(), F.trim(d.substr(at + 6, F.length(d))))


def is_arxiv_doi(x: Column) -> Column:
    d = F.lower(x)
    return F.coalesce(d.startswith("10.48550/") | F.contains(d, F.lit("arxiv")), F.lit(False))


def arxiv_pdf(url: Column) -> Column:
    """PDF address of an abstract page; null for other addresses."""
    last = F.regexp_extract(url, r"(?i).*/abs/([^?#]+)", 1)
    return F.when(last != "", F.concat(F.lit("https://arxiv.org/pdf/"), last))


def publisher(x: Column) -> Column:
    """Publisher by the part of a DOI before the slash; null for others."""
    prefix = F.substring_index(doi(x), "/", 1)
    out = F.lit(None).cast("string")
    for k, v in PUBLISHERS.items():
        out = F.when(prefix == k, v).otherwise(out)
    return out


def acs_article(x: Column) -> Column:
    """Article part of an ACS DOI."""
    return F.nullif(F.regexp_extract(doi(x), r"^10\.1021/(.+)$", 1), F.lit(""))


def springer_journal(x: Column) -> Column:
    """Journal code: of s<number>-, of a Nature code, or null."""
    d = doi(x)
    number = F.regexp_extract(d, r"^10\.(?:1007|1186|1038)/s(\d+)-", 1)
    nature = F.regexp_extract(d, r"^10\.1038/([a-z]+)", 1)
    return F.when(number != "", number).when(nature != "", nature)


def url_in(x: Column) -> Column:
    """The first web address of a text without closing punctuation; null if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(x, r"(https?://[^\s<>\"]+)", 1), r"[.,;:!?)\]]+$", ""), F.lit(""))


#: Bits of the second number of ``packed``.
LOW_BITS = 22


def packed(high: Column, low: Column) -> Column:
    """One long of two numbers, in their order and different for different ones; an error where they do not fit."""
    fits = (high >= 0) & (high < 1 << (63 - LOW_BITS)) & (low >= 0) & (low < 1 << LOW_BITS)
    made = F.shiftleft(high.cast("long"), LOW_BITS).bitwiseOR(low.cast("long"))
    return F.when(high.isNull() | low.isNull(), F.lit(None).cast("long")).when(fits, made).otherwise(F.raise_error(F.lit("numbers too large to pack")))


def hashed(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 12)


def paper_id(doi_: Column, pmid: Column, title: Column, url: Column | None = None) -> Column:
    """``doi:``, ``pmid:``, the address (if given) or ``generated:`` and a hash of the title; empty counts as missing."""
    some = lambda c: c.isNotNull() & (c != "")
    out = F.when(some(doi_), F.concat(F.lit("doi:"), F.lower(doi_))).when(some(pmid), F.concat(F.lit("pmid:"), pmid))
    if url is not None:
        out = out.when(some(url), url)
    return out.otherwise(F.concat(F.lit("generated:"), hashed(F.coalesce(title, F.lit("")))))


def citation_key(family: Column, name: Column, year: Column) -> Column:
    """Family name (else the name's last word) and year, ``n.d.`` without one."""
    last = F.regexp_extract(F.trim(name), r"(\S+)$", 1)
    who = F.coalesce(F.nullif(family, F.lit("")), F.nullif(last, F.lit("")), F.lit("Unknown"))
    return F.concat(who, F.coalesce(year.cast("string"), F.lit("n.d.")))


def kb_display(x: Column) -> Column:
    """Knowledge-base name of letters, digits, ``_`` and ``-``; null if nothing is left."""
    a = F.regexp_replace(F.replace(F.trim(x), F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_-]+", "_")
    return F.nullif(F.regexp_replace(F.regexp_replace(a, "_+", "_"), "^_+|_+$", ""), F.lit(""))


def kb_collection(x: Column) -> Column:
    return F.concat(F.lit("kb_"), F.replace(x, F.lit(" "), F.lit("_")))


def year_of_date(x: Column) -> Column:
    """The four leading digits of a date, else the digits before its first dash; null for others."""
    lead = F.regexp_extract(x, r"^(\d{4})", 1)
    first = F.regexp_extract(x, r"^(\d+)-", 1)
    return F.when(lead != "", lead.cast("int")).when((first != "") & (F.length(first) < 9), first.cast("int"))
