"""The best value of each field in each group of records of one paper.

Groups come from compared records (``records``) and their connected
components. Counts, links and sources follow fixed rules. For the abstract
the group's distinct values are aligned one after another to a growing
profile of token columns, and every value votes in each column with the rows
that carry it: for its token, for a gap inside it, and for the end where it
ends as a text does (one that breaks off has no say about what follows). Of
the existing values the one closest to the voted text survives, if it is what
the field asks for: the whole abstract, plain and alone. If it is not, the
next closest does. What a text shows of damage breaks ties of the vote and
decides that last check, nothing before.

Values of a group are put into profiles of up to BLOCK at most, profiles into
profiles in the same way until a group has one, and the values are compared
with the text it votes for. So no group, however large, is gathered in one
task, and every value has its vote.

Defined results: rows with a null ``paper_no`` are left out; a field without a
usable value gives no row; of equal values the smallest ``paper_no``; null
load times count as the oldest.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm import names as N
from paperlake.llm import persons, records
from paperlake.llm.groups import components
from paperlake.session import cut

#: Values, or profiles, aligned in one task.
BLOCK = 32

# What stands where an abstract is missing.
NO_ABSTRACT = (
    r"^\W*(?:(?:no )?abstracts?(?: is)?(?: not)?(?: available| provided| found)?|not available|n/?a|null|none|nil|nan|tbd|unknown|summary|see (?:pdf|full text)|-+)?\W*$"
)
# Phrases of web pages around an abstract, in lower case.
PAGE = [
    "skip to main content", "skip to content", "sign in |", "log in |", "login |", "download citation", "cookies help us", "cookie help us", "accept all",
    "accept cookies", "share this article", "copy link", "rights and permissions", "cited by", "recommended articles", "copyright notice", "get access",
    "institutional login", "purchase options", "full text at the publisher", "keywords not provided", "funding statement", "ethics declarations",
    "supplementary files", "author information", "next article", "previous article", "all rights reserved", "subscribe to", "view pdf", "view full text",
    "related articles", "this site uses", "©", "http://", "https://",
]
MARKUP = re.compile(r"</?[a-zA-Z][\w:.-]*[^<>]*>|&(?:[a-z]+|#\d+);|\\(?:textit|textbf|emph)\b", re.I)
CUT = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\((?:truncated|continued|more|cut)\)|\[(?:truncated|more|continued)\]|read more|show more|see more)\s*$", re.I)
LABELLED = re.compile(r"^\s*(?:abstract|summary)\s*[:.\-–—]?\s+(?=\S)", re.I)


def hollow(text: Column) -> Column:
    """True for null, for what stands where an abstract is missing, and for text without a letter or number."""
    return text.isNull() | text.rlike("(?iU)" + NO_ABSTRACT)


_END = re.compile(r"[.!?。！？][\"'”’)\]]*\s*$")


def furnished(text: str) -> bool:
    """Whether phrases of a web page stand around or in it."""
    low = text.lower()
    return any(p in low for p in PAGE)


def damaged(text: str) -> bool:
    """Markup, page furniture, a cut end, lost or misread letters, or a label."""
    if text[-1:].isspace():
        return True  # cut between two words
    t = text.strip()
    if not _END.search(t[-8:]) or CUT.search(t[-24:]) or LABELLED.match(t) or "�" in t:
        return True
    if ("<" in t or "&" in t or "\\" in t) and MARKUP.search(t):
        return True
    if t.count("?") > 1 and (len(re.findall(r"\?(?=\w)|\?{3,}", t)) >= 2 or t.count("?") * 15 > len(t)):
        return True
    return furnished(t) or N.mended(t) != t


def tokens(text: str) -> list[str]:
    return (re.sub(r"<[^<>]{1,40}>", " ", text) if "<" in text else text).split()


def align(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j), both rising, of equal tokens: common ends, tokens unique in both in their longest order, and runs around these."""
    n = min(len(x), len(y))
    head = 0
    while head < n and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < n - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    ends = [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    i1, j1 = len(x) - tail, len(y) - tail
    if head < i1 and head < j1:
        at: dict[str, list[int]] = {}
        for i in range(head, i1):
            at.setdefault(x[i], []).append(i)
        seen: dict[str, list[int]] = {}
        for j in range(head, j1):
            if y[j] in at:
                seen.setdefault(y[j], []).append(j)
        both = sorted((js[0], at[t][0]) for t, js in seen.items() if len(js) == 1 == len(at[t]))
        tops: list[int] = []  # patience: the least end of a rising row of each length
        last: list[int] = []
        back: list[int] = []
        for k, (_, i) in enumerate(both):
            p = bisect_left(tops, i)
            back.append(last[p - 1] if p else -1)
            tops[p : p + 1] = [i]
            last[p : p + 1] = [k]
        chain: list[tuple[int, int]] = []
        k = last[-1] if last else -1
        while k >= 0:
            chain.append((both[k][1], both[k][0]))
            k = back[k]
        chain.reverse()
        lo = (head, head)
        for i, j in [*chain, (i1, j1)]:
            a, b = lo
            run: list[tuple[int, int]] = []
            while a < i and b < j and x[a] == y[b]:
                run.append((a, b))
                a, b = a + 1, b + 1
            p, q, more = i - 1, j - 1, []
            while p >= a and q >= b and x[p] == y[q]:
                more.append((p, q))
                p, q = p - 1, q - 1
            out += run + more[::-1]
            if i < i1 or j < j1:
                out.append((i, j))
            lo = (i + 1, j + 1)
    return out + ends


class Profile:
    """Token columns of aligned values, each with the votes of its tokens and of the gap.

    A vote is a pair: rows, and rows times soundness, which breaks ties.
    ``all`` are the votes of all values, ``ending`` of those that say they end.
    """

    def __init__(self, columns, gaps, all_, ending):
        self.columns, self.gaps, self.all, self.ending = columns, gaps, all_, ending

    @classmethod
    def of(cls, text: str, rows: float) -> Profile:
        s = rows * soundness(text)
        words = tokens(text)
        ending = [rows, min(s, rows)] if _END.search(text[-8:]) else [0.0, 0.0]
        return cls([{w: [rows, s]} for w in words], [[0.0, 0.0] for _ in words], [rows, min(s, rows)], ending)

    @classmethod
    def read(cls, text: str) -> Profile:
        return cls(*json.loads(text))

    def write(self) -> str:
        return json.dumps([self.columns, self.gaps, self.all, self.ending])

    def lead(self) -> list[str]:
        return [max(c, key=lambda t: (c[t], t)) if len(c) > 1 else next(iter(c)) for c in self.columns]

    def text(self) -> tuple[list[str], int]:
        """The tokens that win their columns, and how many of them there are up to the last that a value without page furniture says.

        At equal votes a token wins against a gap.
        """
        won = [(t, c[t][1] > 0) for t, c, g in zip(self.lead(), self.columns, self.gaps) if c[t] >= g]
        return [t for t, _ in won], max((i for i, (_, said) in enumerate(won, 1) if said), default=0)

    def add(self, other: Profile) -> None:
        mine, theirs = self.lead(), other.lead()
        pairs = align(mine, theirs)
        columns, gaps = [], []

        def only(c, g, vote):
            columns.append(c)
            gaps.append([g[0] + vote[0], g[1] + vote[1]])

        def both(i, j):
            c, d = self.columns[i], other.columns[j]
            for t, v in d.items():
                old = c.get(t)
                c[t] = [old[0] + v[0], old[1] + v[1]] if old else v
            only(c, self.gaps[i], other.gaps[j])

        x = y = 0
        for i, j in pairs:
            while x < i and y < j:  # tokens that replace each other share a column
                both(x, y)
                x, y = x + 1, y + 1
            for k in range(x, i):
                only(self.columns[k], self.gaps[k], other.all)
            for k in range(y, j):
                only(other.columns[k], other.gaps[k], self.all)
            both(i, j)
            x, y = i + 1, j + 1
        while x < len(mine) and y < len(theirs):
            both(x, y)
            x, y = x + 1, y + 1
        for k in range(x, len(mine)):
            only(self.columns[k], self.gaps[k], other.ending)
        for k in range(y, len(theirs)):
            only(other.columns[k], other.gaps[k], self.ending)
        add = lambda a, b: [a[0] + b[0], a[1] + b[1]]
        self.columns, self.gaps = columns, gaps
        self.all, self.ending = add(self.all, other.all), add(self.ending, other.ending)


def soundness(text: str) -> int:
    """2 for a text without damage, 0 with page furniture around it, else 1."""
    return 2 if not damaged(text) else 0 if furnished(text) else 1


def vote(values: list[tuple[str, float, int]]) -> tuple[list[str], int]:
    """``Profile.text`` of (text, rows, smallest number) by progressive alignment, the most frequent first."""
    first, *rest = (Profile.of(text, rows) for text, rows, _ in sorted(values, key=lambda v: (-v[1], v[2])))
    for p in rest:
        first.add(p)
    return first.text()


def closeness(text: list[str], value: str) -> float:
    """Twice the tokens in common with the consensus by both lengths."""
    words = tokens(value)
    return 1.0 if words == text else 2 * len(align(text, words)) / max(1, len(text) + len(words))


def whole(text: list[str], reach: int, value: str) -> bool:
    """Whether ``value`` is an abstract alone and to its end: it shows no damage, and the consensus does not go on after it."""
    words = tokens(value)
    return not (len(words) < reach and text[: len(words)] == words) and not damaged(value)


def survivor(values: list[tuple[str, float, int]]) -> int | None:
    """Index of the value closest to the consensus that is whole; of equally close ones the more frequent, then the smaller number."""
    if len(values) == 1:  # it is the consensus
        return None if damaged(values[0][0]) else 0
    text, reach = vote(values)
    order = sorted(range(len(values)), key=lambda i: (-round(closeness(text, values[i][0]), 6), -values[i][1], values[i][2]))
    return next((i for i in order if whole(text, reach, values[i][0])), None)


_PROFILED = "group_no long, block long, paper_no long, profile string"


def _runs(batches, columns: int):
    """(key, rows) of the consecutive rows with equal first two columns."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def _rows(found, schema: str):
    """Record batches of the tuples ``found``."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    for row in found:
        held.append(row)
        if len(held) == 2000:
            yield batch()
            held = []
    yield batch()


def _consensus(values: DataFrame) -> DataFrame:
    """_PROFILED of values (group_no, blocks, abstract, weight, paper_no): the survivor of a group of one block, else its blocks' profiles."""

    def run(batches):
        def found():
            for (group, block), rows in _runs(batches, 6):
                held = [(text, weight, no) for _, text, weight, no in rows]
                if rows[0][0] == 1:
                    i = survivor(held)
                    if i is not None:
                        yield group, 0, held[i][2], None
                else:
                    yield group, block, None, _profile([Profile.of(t, w) for t, w, _ in held])

        yield from _rows(found(), _PROFILED)

    placed = values.withColumn("block", F.pmod(F.xxhash64("abstract"), F.col("blocks")))
    return (
        placed.repartition("group_no", "block").sortWithinPartitions("group_no", "block", "paper_no")
        .select("group_no", "block", "blocks", "abstract", "weight", "paper_no").mapInArrow(run, _PROFILED)
    )


def _profile(parts: list[Profile]) -> str:
    for p in parts[1:]:
        parts[0].add(p)
    return parts[0].write()


def _merged(profiles: DataFrame) -> DataFrame:
    """Up to BLOCK profiles of a group made one."""

    def run(batches):
        def found():
            for (group, block), rows in _runs(batches, 3):
                yield group, block, None, _profile([Profile.read(p) for (p,) in rows])

        yield from _rows(found(), _PROFILED)

    up = profiles.select("group_no", F.floor(F.col("block") / BLOCK).cast("long").alias("up"), "block", "profile")
    return up.repartition("group_no", "up").sortWithinPartitions("group_no", "up", "block").select("group_no", "up", "profile").mapInArrow(run, _PROFILED)


def _closest(values: DataFrame, profiles: DataFrame) -> DataFrame:
    """group_no, paper_no of the whole value closest to the consensus of its group's one profile."""

    def text(batches):
        def found():
            for b in batches:
                for group, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield group, json.dumps(Profile.read(p).text())

        yield from _rows(found(), "group_no long, consensus string")

    def run(batches):
        def found():
            read: dict[str, list] = {}
            for b in batches:
                for group, value, weight, no, consensus in zip(*(b.column(i).to_pylist() for i in range(5))):
                    if consensus not in read:
                        read.clear()
                        read[consensus] = json.loads(consensus)
                    words, reach = read[consensus]
                    if whole(words, reach, value):
                        yield group, no, weight, round(closeness(words, value), 6)

        yield from _rows(found(), "group_no long, paper_no long, weight double, close double")

    texts = cut(profiles.select("group_no", "profile").mapInArrow(text, "group_no long, consensus string"))
    near = values.join(texts, "group_no").select("group_no", "abstract", "weight", "paper_no", "consensus")
    scored = near.mapInArrow(run, "group_no long, paper_no long, weight double, close double")
    return scored.groupBy("group_no").agg(F.min(F.struct(-F.col("close"), -F.col("weight"), "paper_no")).alias("m")).select("group_no", "m.paper_no")


def abstracts(rows: DataFrame) -> DataFrame:
    """group_no, paper_no of the surviving abstract of rows (group_no, forms, paper_no, weight, abstract); ``forms``: rows of the group."""
    values = (
        rows.where(~hollow(F.col("abstract")))
        .groupBy("group_no", F.md5("abstract").alias("h"))
        .agg(F.sum("weight").cast("double").alias("weight"), F.min("paper_no").alias("paper_no"), F.first("abstract").alias("abstract"), F.max("forms").alias("forms"))
        .select("group_no", "abstract", "weight", "paper_no", F.ceil(F.col("forms") / BLOCK).alias("blocks"))
    )
    several = cut(values.where("blocks > 1"))
    found = _consensus(values.where("blocks = 1")).select("group_no", "paper_no")
    if several.isEmpty():
        return found
    profiles = cut(_consensus(several))
    while not profiles.where("block > 0").isEmpty():
        profiles = cut(_merged(profiles))
    return found.unionByName(_closest(several, profiles))


def usable_pdf(url: Column) -> Column:
    """A web address of a PDF file itself: no page, login, local path or stub."""
    u = F.lower(F.trim(url))
    path = F.regexp_replace(u, "[?#].*$", "")
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    web = path.rlike("^https?://[^/\\s]+\\.[^/\\s]+/\\S+$")
    no = path.rlike("/(?:login|signin|sign-in|why-no-pdf|no-pdf|abs|abstract|article|viewer|redirect|auth)(?:/[^/]*)?$") | path.rlike("\\.html?$")
    file = path.rlike("\\.pdf$") | path.rlike("/pdf/[^/]+$") | query.rlike("(?:^|&)(?:format|type|output|download)=(?:pdf|[^&]*\\.pdf)(?:&|$)")
    return web & ~no & file


def grouped(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((paper_no, rep, group_no, forms) of every row that shares its paper with another, (no, text) of all reps among them).

    ``rep`` is the first of the rows equal in all that is compared, ``forms`` the number of such in the group.
    """
    common = persons.common_given(papers.select(F.explode("authors").alias("x")).select("x.name", "x.given"))
    rows = cut(records.forms(papers, 0, "paper_no", "title", "authors", "year", "doi", common, "abstract"))
    marked = cut(records.distinct_forms(rows))
    cands, met = records.pairs(marked, across=False)
    nodes = met.select("no").unionByName(marked.where("no <> rep").select(F.col("rep").alias("no"))).distinct()
    texts = papers.where(F.col("paper_no").isNotNull()).select(F.col("paper_no").cast("long").alias("no"), F.col("abstract").alias("text"))
    some = cut(rows.drop("keys", "text_hash", "side").join(nodes, "no", "left_semi").join(texts, "no"))
    links = records.compared(cands, some, some).where(records.is_same()).select("a", "b")
    roots = components(links)
    placed = cut(
        marked.join(roots.withColumnRenamed("no", "rep"), "rep", "left").select(F.col("no").alias("paper_no"), "rep", F.coalesce("root", "rep").alias("root"))
    )
    several = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("paper_no").alias("group_no"), F.count_if(F.col("paper_no") == F.col("rep")).alias("forms")).where("n > 1")
    return cut(placed.join(several, "root").select("paper_no", "rep", "group_no", "forms")), some.select("no", "text")


def survivors(papers: DataFrame, catalog: DataFrame) -> DataFrame:
    """group_no, field_name, paper_no: the row whose value survives, per group and field."""
    ranks = catalog.groupBy(F.lower(F.trim("source_name")).alias("s")).agg(F.min("trust_rank").alias("trust"))
    # the catalogue has one row per source and is joined by its measured size
    cols = papers.select("paper_no", "citation_count", "pdf_url", "loaded_at", F.lower(F.trim("source")).alias("s"))
    rows, texts = grouped(papers)
    full = rows.join(cols, "paper_no").join(ranks, "s", "left")
    at = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62)))
    counted = F.col("citation_count") >= 0
    linked = F.coalesce(usable_pdf(F.col("pdf_url")), F.lit(False))
    best = full.groupBy("group_no").agg(
        F.max(F.when(counted, F.struct(at.alias("t"), (-F.col("paper_no")).alias("n")))).alias("c"),
        F.max(F.when(linked, F.struct(at.alias("t"), (-F.col("paper_no")).alias("n")))).alias("p"),
        F.min(F.when(F.col("trust").isNotNull(), F.struct("trust", "paper_no"))).alias("s"),
    )
    fields = best.select(
        "group_no",
        F.explode(
            F.array(
                F.struct(F.lit("citation_count").alias("field_name"), (-F.col("c.n")).alias("paper_no")),
                F.struct(F.lit("pdf_url").alias("field_name"), (-F.col("p.n")).alias("paper_no")),
                F.struct(F.lit("source").alias("field_name"), F.col("s.paper_no").alias("paper_no")),
            )
        ).alias("x"),
    ).select("group_no", "x.field_name", "x.paper_no")
    weights = rows.groupBy("group_no", "rep").agg(F.count("*").alias("weight"), F.max("forms").alias("forms"))
    said = weights.join(texts, F.col("rep") == F.col("no")).select("group_no", "forms", F.col("rep").alias("paper_no"), "weight", F.col("text").alias("abstract"))
    return fields.where("paper_no IS NOT NULL").unionByName(
        abstracts(said).select("group_no", F.lit("abstract").alias("field_name"), "paper_no")
    )
