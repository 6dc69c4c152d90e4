"""HTML and JATS XML read with the standard library, in Arrow batches.

Null, blank and malformed input gives null text and no sections or references.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_TEXT = StructType([StructField("title", StringType()), StructField("text", StringType())])
_SECTION = StructType([StructField("ord", IntegerType()), StructField("section", StringType()), StructField("content", StringType())])
_REFERENCE = StructType(
    [StructField("ord", IntegerType()), *[StructField(c, StringType()) for c in ("doi", "title", "journal", "year")],
     StructField("authors", ArrayType(StringType())), StructField("text", StringType())]
)
# Elements without content, and those whose text is no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style"}
HEADINGS = {"h1", "h2", "h3"}


class Page(HTMLParser):
    """Text pieces of a page with the elements around them."""

    def __init__(self, dropped: set[str] = DROPPED):
        super().__init__(convert_charrefs=True)
        self.dropped, self.stack = dropped, []
        self.pieces: list[tuple[tuple[str, ...], str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not self.dropped & set(self.stack):
            self.pieces.append((tuple(self.stack), data))


def pieces(html: str, dropped: set[str] = DROPPED) -> list[tuple[tuple[str, ...], str]]:
    page = Page(dropped)
    page.feed(html)
    page.close()
    return page.pieces


def read_html(html: str | None) -> dict | None:
    """title (of <title>, else <h1>) and text (of <article>, else <main>, else all), a line per piece."""
    if not html or not html.strip():
        return None
    found = pieces(html)
    of = lambda tag: [t.strip() for s, t in found if tag in s]
    title = "".join(of("title")) or "".join(of("h1")) or None
    body = next((x for x in (of("article"), of("main")) if x), [t.strip() for _, t in found])
    lines = [p.strip() for t in body for line in t.splitlines() for p in line.split("  ")]
    return {"title": title, "text": "\n".join(x for x in lines if x)}


def html_sections(html: str | None, least: int = 50) -> list[dict]:
    """Sections of a page under its h1 to h3, navigation left out, those of more than ``least`` characters."""
    if not html:
        return []
    out: list[list] = []
    name: list[str] = []
    open_ = False
    for stack, text in pieces(html, DROPPED | {"nav", "header", "footer", "title"}):
        if HEADINGS & set(stack):
            name = [*name, text.strip()] if open_ else [text.strip()]
            open_ = True
            continue
        if open_ or not out:
            out.append([" ".join(name) or "_full", []])
            open_ = False
        out[-1][1].append(text.strip())
    kept = [(n, "\n".join(t)) for n, t in out if len("\n".join(t)) > least]
    return [{"ord": i, "section": n, "content": t} for i, (n, t) in enumerate(kept)]


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _root(xml):
    try:
        return ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        return None


def _first(root, name: str):
    return next((e for e in root.iter() if _local(e) == name), None) if root is not None else None


def _all_text(e) -> str:
    return "".join(e.itertext()).strip()


def jats_text(xml: str | None, least: int = 200) -> str | None:
    """Body text with blank lines around titles and paragraphs; null for ``least`` characters or fewer."""
    body = _first(_root(xml), "body")
    if body is None:
        return None
    out: list[str] = []

    def walk(e):
        name = _local(e)
        out.append("\n\n" if name in ("title", "label") else "")
        out.append(e.text or "")
        for child in e:
            walk(child)
            out.append(child.tail or "")
        out.append("\n\n" if name in ("p", "sec", "section") else "")

    walk(body)
    text = re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", "".join(out).strip()))
    return text if len(text) > least else None


def jats_sections(xml: str | None) -> list[dict]:
    """Sections by nested titles (``A > B``); of equal titles the last; the abstract at the end."""
    root = _root(xml)
    body = _first(root, "body")
    if body is None:
        return []
    found: dict[str, str] = {}

    def walk(e, above: str):
        for sec in (c for c in e if _local(c) == "sec"):
            title = next((c for c in sec if _local(c) == "title"), None)
            name = (title.text or "").strip() if title is not None else "Unknown Section"
            full = f"{above} > {name}" if above else name
            skip = ("sec", "title", "fig", "table-wrap", "xref", "ref-list")
            paras = [t for c in sec if _local(c) not in skip and (t := _all_text(c))]
            if paras:
                found[full] = "\n\n".join(paras)
            walk(sec, full)

    walk(body, "")
    abstract = _first(root, "abstract")
    if abstract is not None and _all_text(abstract):
        found["Abstract"] = _all_text(abstract)
    return [{"ord": i, "section": k, "content": v} for i, (k, v) in enumerate(found.items())]


def jats_references(xml: str | None) -> list[dict]:
    """References: DOI, title, journal, year and authors, the whole text where there is no title."""
    refs = _first(_root(xml), "ref-list")
    out: list[dict] = []
    for ref in (r for r in (refs if refs is not None else ()) if _local(r) == "ref"):
        cite = _first(ref, "mixed-citation")
        cite = _first(ref, "element-citation") if cite is None else cite
        if cite is None:
            if _all_text(ref):
                out.append({"text": _all_text(ref)})
            continue
        row: dict = {}
        for e in (x for x in cite.iter() if _local(x) == "ext-link"):
            link = next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "href"), None) or (e.text or "").strip()
            if "doi.org/" in link:
                row["doi"] = link.split("doi.org/")[-1]
                break
        ids = [x for x in cite.iter() if _local(x) == "pub-id" and x.get("pub-id-type") == "doi" and x.text]
        if "doi" not in row and ids:
            row["doi"] = ids[0].text.strip()
        for column, name in (("title", "article-title"), ("journal", "source"), ("year", "year")):
            e = next((c for c in cite if _local(c) == name), None)
            if e is not None and _all_text(e):
                row[column] = _all_text(e)
        people = []
        for e in (x for x in cite.iter() if _local(x) == "name"):
            parts = [(p.text or "").strip() for want in ("given-names", "surname") for p in e if _local(p) == want]
            if any(parts):
                people.append(" ".join(p for p in parts if p))
        if people:
            row["authors"] = people
        if "title" not in row and _all_text(cite):
            row["text"] = _all_text(cite)
        if row:
            out.append(row)
    return [{"ord": i} | {c: r.get(c) for c in ("doi", "title", "journal", "year", "authors", "text")} for i, r in enumerate(out)]


def xml_paragraphs(xml: str | None, least: int = 10) -> list[str]:
    """Texts of elements named like ``para`` in the body, of the whole file if the body has fewer than three."""
    root = _root(xml)
    if root is None:
        return []
    body = _first(root, "body")
    get = lambda e: [t for x in e.iter() if "para" in _local(x).lower() and len(t := _all_text(x)) > least]
    inside = get(body) if body is not None else []
    return inside if len(inside) >= 3 else get(root)


@F.pandas_udf(_TEXT)
def _html(s: pd.Series) -> pd.DataFrame:
    rows = [read_html(t) or {"title": None, "text": None} for t in s]
    return pd.DataFrame(rows, columns=["title", "text"])


@F.pandas_udf(StringType())
def _jats_text(s: pd.Series) -> pd.Series:
    return s.map(jats_text)


@F.pandas_udf(ArrayType(_SECTION))
def _jats_sections(s: pd.Series) -> pd.Series:
    return s.map(jats_sections)


@F.pandas_udf(ArrayType(_SECTION))
def _html_sections(s: pd.Series) -> pd.Series:
    return s.map(html_sections)


@F.pandas_udf(ArrayType(_REFERENCE))
def _jats_references(s: pd.Series) -> pd.Series:
    return s.map(jats_references)


@F.pandas_udf(ArrayType(StringType()))
def _xml_paragraphs(s: pd.Series) -> pd.Series:
    return s.map(xml_paragraphs)


def html_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, text of each page."""
    return df.select(key, _html(F.col(html)).alias("p")).select(key, "p.title", "p.text")


def html_parts(df: DataFrame, key: str, html: str) -> DataFrame:
    return df.select(key, F.explode(_html_sections(F.col(html))).alias("s")).select(key, "s.*")


def article_text(df: DataFrame, key: str, xml: str) -> DataFrame:
    return df.select(key, _jats_text(F.col(xml)).alias("text"))


def article_sections(df: DataFrame, key: str, xml: str) -> DataFrame:
    return df.select(key, F.explode(_jats_sections(F.col(xml))).alias("s")).select(key, "s.*")


def article_references(df: DataFrame, key: str, xml: str) -> DataFrame:
    return df.select(key, F.explode(_jats_references(F.col(xml))).alias("r")).select(key, "r.*")


def publisher_paragraphs(df: DataFrame, key: str, xml: str) -> DataFrame:
    return df.select(key, F.posexplode(_xml_paragraphs(F.col(xml))).alias("ord", "text"))
