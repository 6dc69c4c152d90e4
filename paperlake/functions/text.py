"""Scalar text functions as Spark columns; Python only where the JVM has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words dropped from key terms.
KEY_STOPWORDS = (
    "the and or of to a in that it is are was were be been being have has had do does did can could will would should "
    "what which who when where why how many much this these those some any all with for from about as"
).split()
# Words dropped from token sets.
SET_STOPWORDS = (
    "the a an of in for to and or on at by with from as is are was were be been being this that these those it its into "
    "than then not no we our their they he she his her which what when where who how all any each both"
).split()
# Words that mark a demanding question.
COMPLEX_MARKERS = ["compare", "difference", "explain", "analyze", "how", "why"]
# Characters stripped from both ends of a key term.
KEY_STRIP = ".,?!:;()[]{}\"'"
# Fixed value: a DOI in running text.
DOI = r"10\.\d{4,9}/[^\s\])>'\",]+"


def strip(x: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def words(x: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def alnum_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


def space_tokens(x: Column) -> Column:
    """Lower-case parts between white space."""
    return words(F.lower(x))


def key_terms(x: Column, least: int = 3) -> Column:
    """Lower-case words without outer punctuation, stop words, short words and numbers; repeats kept."""
    ends = "".join("\\" + c for c in KEY_STRIP)
    bare = F.transform(words(F.lower(x)), lambda t: F.regexp_replace(t, f"^[{ends}]+|[{ends}]+$", ""))
    return F.filter(bare, lambda t: ~t.isin(KEY_STOPWORDS) & (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))


def complexity(x: Column) -> Column:
    """0 to 1 from the number of words, their length, question marks and marker words."""
    w = words(x)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda a, t: a + F.length(t))
    marks = F.length(x) - F.length(F.replace(x, F.lit("?"), F.lit("")))
    found = sum((F.contains(F.lower(x), F.lit(m)).cast("int") for m in COMPLEX_MARKERS), F.lit(0))
    one = F.lit(1.0)
    return (
        F.least(one, n / F.lit(25.0)) * 0.4
        + F.least(one, letters / F.greatest(F.lit(1), n) / F.lit(8.0)) * 0.2
        + F.least(one, marks / F.lit(2.0)) * 0.1
        + F.least(one, found / F.lit(2.0)) * 0.3
    )


def temperature(c: Column, mode: str = "advanced") -> Column:
    """Sampling temperature for a complexity."""
    if mode == "advanced":
        return F.when(c > 0.7, 0.7).otherwise(0.3)
    return F.when(c < 0.7, 0.3).otherwise(0.5)


def plain(text: str | None) -> str | None:
    if text is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return t.translate({0x2013: "-", 0x2014: "-", 0x2212: "-", 0x2010: "-"}).lower()


@F.pandas_udf(StringType())
def _plain_udf(s: pd.Series) -> pd.Series:
    return s.map(plain, na_action="ignore")


def normalized(x: Column) -> Column:
    """Lower case without accents, four dashes as ``-``. ASCII text stays in the JVM."""
    ascii_ = x.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, F.lower(x)).otherwise(_plain_udf(F.when(~ascii_, x)))


def token_set(normal: Column) -> Column:
    """Distinct ASCII words of two characters or more without stop words, of normalized text."""
    found = F.regexp_extract_all(normal, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(SET_STOPWORDS)))


def title_match(a: Column, b: Column) -> Column:
    """1 if one normalized title holds the other, else shared words over the larger set; 0 for blank."""
    sa, sb = token_set(a), token_set(b)
    most = F.greatest(F.size(sa), F.size(sb))
    part = F.when((F.size(sa) > 0) & (F.size(sb) > 0), F.size(F.array_intersect(sa, sb)) / most).otherwise(F.lit(0.0))
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, F.lit(0.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(1.0)).otherwise(part)


def quoted(x: Column) -> Column:
    """Quoted strings of 12 to 600 characters, in order."""
    both = F.regexp_extract_all(x, F.lit("(\"[^\"]{12,600}\"|'[^']{12,600}')"), F.lit(1))
    bare = F.transform(both, lambda q: F.trim(q.substr(F.lit(2), F.length(q) - 2)))
    return F.filter(bare, lambda q: F.length(q) >= 12)


def dois(x: Column) -> Column:
    """Distinct normalized DOIs in order of appearance."""
    from paperlake.functions import ids

    found = F.regexp_extract_all(x, F.lit(f"(?i)({DOI})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, ids.doi), lambda d: d != ""))


def token_estimate(x: Column) -> Column:
    """A quarter of the characters plus half of those beyond ASCII, both rounded down; 0 for null."""
    wide = F.length(F.regexp_replace(x, r"[\x00-\x7F]", ""))
    return F.coalesce(F.floor(F.length(x) / 4) + F.floor(wide / 2), F.lit(0)).cast("long")


def cut_at_space(x: Column, chars: int, mark: str = "...") -> Column:
    """The first ``chars`` characters up to their last space, with ``mark``; shorter text unchanged."""
    head = F.left(x, F.lit(chars))
    to_space = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(x) > chars, F.concat(to_space, F.lit(mark))).otherwise(x)


def truncated(x: Column, tokens: int) -> Column:
    """Text cut to an estimate of ``tokens`` tokens (four characters each)."""
    return cut_at_space(x, 4 * tokens)


def pdf_text(x: Column) -> Column:
    """One line where more than a twentieth of the characters are line ends, else trimmed text."""
    ends = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return F.when(ends > F.length(x) * 0.05, F.trim(F.regexp_replace(x, r"\s+", " "))).otherwise(x)


def unfused(x: Column) -> Column:
    """A space where a small letter meets a capitalised word."""
    return F.regexp_replace(x, r"([a-z])([A-Z][a-z])", "$1 $2")


def author_display(names: Column) -> Column:
    """Family name, ``A & B``, ``A et al.`` or null, of an array of full names."""
    last = lambda i: F.regexp_extract(F.trim(F.element_at(names, i)), r"(\S+)$", 1)
    n = F.size(names)
    return F.when(n == 1, last(1)).when(n == 2, F.concat(last(1), F.lit(" & "), last(2))).when(n > 2, F.concat(last(1), F.lit(" et al.")))


def author_list(x: Column) -> Column:
    """Names of a comma-separated string; an empty array for null."""
    parts = F.filter(F.transform(F.split(x, ","), F.trim), lambda a: a != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def reference_line(i: Column, title: Column, authors: Column, year: Column, doi: Column) -> Column:
    """``[i] title - authors (year) - DOI: doi`` without the parts that are missing."""
    some = lambda c, *x: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(*x)).otherwise("")
    return F.concat(
        F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(title, F.lit("None")),
        some(authors, F.lit(" - "), authors), some(year, F.lit(" ("), year.cast("string"), F.lit(")")),
        some(doi, F.lit(" - DOI: "), doi),
    )


def academic_reference(i: Column, title: Column, names: Column, year: Column, doi: Column) -> Column:
    """Numbered reference with a link and the full citation where there is a DOI."""
    from paperlake.functions import ids

    d = ids.doi_prefix_free(doi)
    y = F.coalesce(year.cast("string"), F.lit("n.d."))
    t = F.coalesce(title, F.lit("Unknown Title"))
    n = F.size(names)
    who = (
        F.when(n == 1, F.element_at(names, 1))
        .when(n == 2, F.concat(F.element_at(names, 1), F.lit(" & "), F.element_at(names, 2)))
        .when(n > 2, F.concat(F.element_at(names, 1), F.lit(" et al.")))
        .otherwise("Unknown")
    )
    full = F.when(n > 0, F.concat(F.array_join(names, ", "), F.lit(". "), y, F.lit(". "), t, F.lit("."))).otherwise(
        F.concat(t, F.lit(". "), y, F.lit("."))
    )
    no = F.concat(i.cast("string"), F.lit(". "))
    linked = F.concat(no, F.lit("["), who, F.lit(", "), y, F.lit("](https://doi.org/"), d, F.lit(' "'), full, F.lit('")'))
    return F.when(F.coalesce(d, F.lit("")) != "", linked).otherwise(F.concat(no, who, F.lit(", "), y, F.lit(". "), t, F.lit(".")))


def paper_block(i: Column, title: Column, authors: Column, year: Column, doi: Column, score: Column, text: Column, chars: int = 4000) -> Column:
    """Header line and text of a paper, the text cut at ``chars``."""
    some = lambda c, *x: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(*x)).otherwise("")
    head = F.concat(
        F.lit("[Paper "), i.cast("string"), F.lit("]"), some(title, F.lit(" "), title), some(authors, F.lit(" — "), authors),
        some(year, F.lit(" ("), year.cast("string"), F.lit(")")), some(doi, F.lit(" | DOI: "), doi),
        F.lit(" | relevance: "), F.format_string("%.2f", score),
    )
    body = F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("\n[...truncated]"))).otherwise(F.coalesce(text, F.lit("")))
    return F.concat(head, F.lit("\n\n"), body)


def document_block(i: Column, source: Column, text: Column) -> Column:
    return F.concat(F.lit("["), i.cast("string"), F.lit("] Source: "), F.coalesce(source, F.lit("Unknown")), F.lit("\n"), text)


def json_slice(x: Column) -> Column:
    """The JSON object in an answer: in a fenced block, else from the first to the last brace; null if none."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    raw = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(raw != "", raw)


def json_repaired(x: Column) -> Column:
    """JSON without code fences and trailing commas."""
    bare = F.regexp_replace(x, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.trim(F.regexp_replace(bare, r",(\s*[}\]])", "$1"))


def fingerprint(title: Column) -> Column:
    """The first 120 letters and digits of a title in lower case."""
    return F.left(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""), F.lit(120))


def cited(x: Column) -> Column:
    """Distinct numbers cited as ``[n]`` or ``[n, m]``, ascending."""
    groups = F.regexp_extract_all(x, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))
