"""Bibliographic records in a comparable form, candidate pairs and their comparison."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm import names as N
from paperlake.session import cut, spread

# Words that carry no title.
STOP = frozenset("a an the of and in on for to at by from with under along during after over between its their is are does how as via using".split())
# Labels before and after a title that are no part of it.
LABEL = re.compile(
    r"^\s*(?:\((?:pdf|html|preprint|full text|online first)\)|\[(?:article|pdf|html|preprint|research article|review|book|citation|[a-z ]{3,20})\]"
    r"|(?:title|research article|original (?:article|research|paper)|article|full paper|short communication|preprint|review article|brief report)\s*[:\-–])\s*",
    re.I,
)
TAIL = re.compile(r"\s*(?:\((?:pdf|preprint|online first|in press|author manuscript)\)|\[(?:preprint|pdf|internet|online)\])\s*$", re.I)
# Openings of papers about another paper.
ABOUT = re.compile(r"^(comment(?:ary|s)?|reply|response|rejoinder|corrigendum|correction|erratum|errata|addendum|retraction|retracted|expression of concern)\b\W*(?:article\W+)?(?:notice\W+)?(?:on|to|of|for)?\b\W*")
PART = re.compile(r"(?:[\s:,;.\-–(]+(?:part|pt\.?|no\.?|volume|vol\.?|chapter)\s*\.?\s*([ivx]+|\d{1,2}|[a-h])\b\)?|\s+(i{1,3}|iv|vi{0,3}|ix|x))\W*$")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
EMPTY = re.compile(r"^\W*(?:null|none|n/?a|nan|untitled|unknown|no title|title|\[no title\]|-+|\?+)?\W*$", re.I)

FORM = "no long, side int, title string, cut boolean, tag string, people array<string>, year int, doi string, text_hash long, keys array<long>, sign array<long>"

_LAST = re.compile(r"[^\W_]+(?=\W*$)")


def read_title(raw: str | None) -> tuple[str, bool, str]:
    """(words, cut short, tag): the tag tells a part, reply or correction from the paper itself."""
    t = raw or ""
    if "<" in t:
        t = re.sub(r"<[^<>]{1,40}>", "", t)
    if "&" in t:
        t = html.unescape(t).replace("&", " and ")
    t = " ".join(t.split())
    if t[:1] in "([" or ":" in t[:24] or "-" in t[:24] or "–" in t[:24]:
        for _ in range(2):
            t = LABEL.sub("", t)
    if t[-1:] in ")]":
        t = TAIL.sub("", t)
    if EMPTY.match(t):
        return "", False, ""
    short = t.endswith(("...", "…", "[...]"))
    t = N.fold(t.replace("{", "").replace("}", "")).strip()
    tag = ""
    m = ABOUT.match(t)
    if m and len(t) > m.end() + 8 and (re.search(r"\b(?:on|to|of|for)\b|:", m[0])):
        tag, t = m[1][:6], t[m.end() :]
    # only a last word this short can number a part
    if not short and (w := _LAST.search(t, max(0, len(t) - 24))) and len(w[0]) <= 5 and (p := PART.search(t)):
        v = p[1] or p[2]
        tag += f"#{ROMAN.get(v) or (int(v) if v.isdigit() else ord(v) - 96)}"
        t = t[: p.start()]
    return " ".join(re.findall(r"[a-z0-9]+", t)), short, tag


def read_doi(raw: str | None) -> str | None:
    """The DOI in lower case without resolver, version or trailing dots; null for what is none."""
    m = re.search(r"10\.\d{4,9}/[^\s\"<>]+", unquote(raw or "").lower())
    return (re.sub(r"(?<=\d)v\d{1,2}$", "", m[0].rstrip(".,;)")) or None) if m else None


def read_year(raw: str | None) -> int | None:
    """A year from a date in any form; two digits after an apostrophe are of this century up to 30."""
    if not raw:
        return None
    if m := re.search(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", raw):
        return int(m[1])
    if m := re.search(r"['’](\d\d)(?!\d)", raw):
        return 2000 + int(m[1]) if int(m[1]) <= 30 else 1900 + int(m[1])
    return None


_WORD = re.compile("[A-Za-z]{2,}")
_UMLAUT = re.compile("([aou])e")
_NO_NAME = frozenset({"others", "anonymous", "unknown", "null", "and", "et", *N.NOISE, *N.PARTICLES, *N.ORG_WORDS})


def read_people(texts: list[str | None], known: N.Known) -> list[str]:
    """Folded name words that are no initials, particles or common given names.

    Words of two or three letters count unless they are all capitals, as initials are.
    """
    text = " ; ".join(t for t in texts if t)
    if not text.isascii():
        if N.MOJIBAKE.search(text):
            text = ";".join(N.mended(t) for t in re.split("[;|]", text))
        text = N.unaccented(text)
    if "(" in text:
        text = re.sub(r"\([^)]*\)", " ", text)
    kept, words = known.words, set()
    for w in _WORD.findall(text):
        if w not in kept:
            v = _UMLAUT.sub(r"\1", w.lower())
            kept[w] = v if (len(w) > 3 or not w.isupper()) and v not in _NO_NAME and v not in known else None
        if kept[w]:
            words.add(kept[w])
    return sorted(words)


def keys_of(title: str, tag: str, people: list[str], doi: str | None) -> list[int]:
    """64-bit candidate keys of a record: its DOI and parts of its title.

    A title's content words are ordered by their length, then by a hash. Each
    three of its first four are a key, so two titles that differ in any one
    word share one whatever their length: the first three of the words in
    common are among the first four of both. The first four words as typed are
    a key, and the first two, in any order, with each author, which survive a
    cut end. A title of fewer than four words, which says little, has keys
    with authors only, by each word too. The order hangs on the words alone, so keys are the same
    in any corpus. Equal hashes of different keys cost a comparison, no more.
    A DOI's key is odd, the others are even.
    """
    hashed, out = xxhash.xxh64_intdigest, set()
    h = lambda *x: (hashed("|".join(x)) & ~1) - (1 << 63)
    words = [w for w in title.split() if w not in STOP] or title.split()
    if words:
        best = sorted(set(words), key=lambda w: (-len(w), zlib.crc32(w.encode())))[:4]
        if len(best) == 4:
            for i in range(4):
                out.add(h("r", tag, *sorted(best[:i] + best[i + 1 :])))
            out.add(h("a", tag, *words[:4]))
        first = [" ".join(sorted(words[:2]))] + (best if len(best) < 4 else [])
        for f in first:
            start = f"s|{tag}|{f}|"
            out.update((hashed(start + p) & ~1) - (1 << 63) for p in people)
    if doi:
        out.add(h("d", doi) | 1)
    return sorted(out)


#: Titles are near or one the beginning of the other only if at most this many bits of one's signature are not in the other's:
#: three slight differences of at most three pairs of letters each.
BITS = 9


def signature(title: str) -> list[int]:
    """Which pairs of neighbouring letters stand in a title without its spaces, hashed to 128 bits in two numbers."""
    return signatures([title])[0].tolist()


def signatures(titles: list[str]) -> np.ndarray:
    """``signature`` of each title, one row each. Titles are words of a to z and 0 to 9."""
    plain = [t.replace(" ", "") for t in titles]
    lens = np.array([len(t) for t in plain], dtype="int64")
    letters = np.frombuffer("".join(plain).encode("ascii"), dtype="uint8").astype("int64")
    row = np.repeat(np.arange(len(plain)), lens)
    within = row[:-1] == row[1:]
    bits = np.zeros((len(plain), 128), dtype="uint8")
    bits[row[:-1][within], ((letters[:-1] * 37 + letters[1:]) & 127)[within]] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def forms(
    df: DataFrame, side: int, no: str, title: str, people: str, date: str, doi: str, common: frozenset[str], text: str | None = None
) -> DataFrame:
    """FORM of each row; ``people`` is an array of structs with ``name`` or one string.

    ``text_hash`` is a hash of ``text``, null where none is given or stands.
    """
    nested = not df.schema[people].dataType.simpleString().startswith("string")
    names = F.transform(people, lambda p: p["name"]) if nested else F.array(people)

    def run(batches):
        known = N.Known(common)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(1, 5)]
            titles = [read_title(t) for t in cols[0]]
            who = [read_people(x or [], known) for x in cols[1]]
            dois = [read_doi(x) for x in cols[3]]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([side] * b.num_rows, pa.int32()),
                    pa.array([t[0] for t in titles], pa.string()),
                    pa.array([t[1] for t in titles], pa.bool_()),
                    pa.array([t[2] for t in titles], pa.string()),
                    pa.array(who, pa.list_(pa.string())),
                    pa.array([read_year(x) for x in cols[2]], pa.int32()),
                    pa.array(dois, pa.string()),
                    b.column(5),
                    pa.array([keys_of(t[0], t[2], p, d) for t, p, d in zip(titles, who, dois)], pa.list_(pa.int64())),
                    pa.array(list(signatures([t[0] for t in titles])), pa.list_(pa.int64())),
                ],
                [x.split()[0] for x in FORM.split(", ")],
            )

    plain = df.where(F.col(no).isNotNull()).select(
        F.col(no).cast("long").alias("no"), F.col(title).alias("t"), names.alias("p"), F.col(date).cast("string").alias("d"), F.col(doi).alias("doi"),
        (F.when(F.col(text).isNotNull(), F.xxhash64(text)) if text else F.lit(None).cast("long")).alias("x"),
    )
    return spread(plain).mapInArrow(run, FORM)


def distinct_forms(rows: DataFrame) -> DataFrame:
    """no, side, rep, keys, sign of each row of FORM: copies are compared once.

    ``rep`` is the smallest number of the rows of one form and side, which
    alone keeps its keys; a row with neither title nor DOI is no copy of another. The counts are combined before the shuffle; a form
    of many rows has one row on the other side of the join.
    """
    parts = ["side", "title", "cut", "tag", "people", "year", "doi", "text_hash"]
    f = [F.xxhash64(*parts).alias("f1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("f2")]
    first = rows.groupBy(*f).agg(F.min("no").alias("least"))
    says = (F.col("title") != "") | F.col("doi").isNotNull()
    rep = F.when(F.col("says"), F.col("least")).otherwise(F.col("no"))
    return rows.select("no", "side", "keys", "sign", says.alias("says"), *f).join(first, ["f1", "f2"]).select(
        "no", "side", rep.alias("rep"), F.when(F.col("no") == rep, F.col("keys")).alias("keys"), F.when(F.col("no") == rep, F.col("sign")).alias("sign")
    )


#: Rows of a key in one task of the pairing; more are dealt to several tasks.
SLICE = 512


def pairs(marked: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """(distinct (a, b) that share a key, the numbers in any of them).

    ``across``: a of side 0 and b of side 1, else a < b. Pairs by a key of the
    title whose signatures show that the titles are neither near nor one the
    beginning of the other are left out; without a common DOI no such pair is
    ever one paper. The left side of a key of many rows is dealt to slices,
    the right side repeated to each, so no task meets more than SLICE rows of
    it times all.
    """
    keys = marked.where("no = rep").select("no", "side", "sign", F.explode("keys").alias("k"))
    counts = keys.groupBy("k").agg(F.count("*").alias("n"), F.max("side").alias("hi"), F.min("side").alias("lo"))
    several = cut(keys.join(counts.where("lo < hi" if across else "n > 1").select("k", "n"), "k"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    a = several.select(F.col("no").alias("a"), F.col("side").alias("sa"), F.col("sign").alias("x"), "k", F.pmod(F.xxhash64("no"), slices).cast("int").alias("s"))
    b = several.select(F.col("no").alias("b"), F.col("side").alias("sb"), F.col("sign").alias("y"), "k", F.explode(F.sequence(F.lit(0), slices - 1)).alias("s"))
    both = a.where("sa = 0").join(b.where("sb = 1"), ["k", "s"]) if across else a.join(b, ["k", "s"]).where("a < b")
    beyond = lambda p, q: sum(F.bit_count(F.col(p)[i].bitwiseAND(F.bitwise_not(F.col(q)[i]))) for i in (0, 1))
    alike = F.least(beyond("x", "y"), beyond("y", "x")) <= BITS
    both = both.where((F.col("k") % 2 != 0) | alike)
    return both.select("a", "b").distinct(), several.select("side", "no").distinct()


def title_match(a: str, b: str, cut_a: bool, cut_b: bool) -> str:
    """``same``, ``near``, ``part`` (one is the beginning of the other), ``word`` (one word differs), ``other`` or ``none``."""
    if not a or not b:
        return "none"
    x, y = a.split(), b.split()
    sa, sb = "".join(x), "".join(y)
    if sa == sb:
        return "same"
    short, long = (sa, sb) if len(sa) <= len(sb) else (sb, sa)
    if long.startswith(short) and len(short) >= 18:
        return "part"
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    j = 0
    while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
        j += 1
    rx, ry = x[i : len(x) - j], y[i : len(y) - j]
    # each difference takes a word of the longer rest, and neither ``near`` nor ``word`` allows more than three
    if not (cut_a or cut_b) and max(len(rx), len(ry)) - (Counter(rx) & Counter(ry)).total() > 3:
        return "other"
    apart = _unlike(rx, ry) > 1  # two major differences at least
    if apart and not (cut_a or cut_b):
        return "other"
    minor, major = (0, 2) if apart else _align(rx, ry)
    if major == 0 and minor <= 3:
        return "near"
    if cut_a or cut_b:  # one text ends early: the rest of the other is no difference
        n = min(len(sa), len(sb))
        shorter, longer = (x, y) if len(sa) <= len(sb) else (y, x)
        begun = shorter[:-1], longer[: len(shorter) - 1]
        m, k = _align(*begun) if n >= 18 and not _unlike(*begun) else (0, 1)
        if k == 0 and m <= 2:
            return "part"
    return "word" if major == 1 and minor <= 1 else "other"


def _typo(a: str, b: str) -> bool:
    """One typing error apart, but not two numbers that differ in a digit."""
    return N.near(a, b) and not any(x != y and x.isdigit() and y.isdigit() for x, y in zip(a, b) if len(a) == len(b))


def _stands(a: str, b: str) -> bool:
    """Whether one word in the other's place is no major difference."""
    return a == b or _typo(a, b) or (a in STOP and b in STOP)


def _unlike(x: list[str], y: list[str]) -> int:
    """Major differences that any alignment of two word lists has at least.

    A word for which none of the other list can stand is missing there or in
    another's place. Each of the latter is major, and so is each word missing
    in one list together with one missing in the other.
    """

    def alone(p: list[str], q: list[str]) -> int:
        rest = set(q)
        return sum(1 for w in p if w not in rest and not any(_stands(w, v) for v in rest))

    n = alone(x, y)
    return n and min(n, alone(y, x))


def _align(x: list[str], y: list[str]) -> tuple[int, int]:
    """(minor, major) differences of two word lists, the least of all alignments.

    Typing errors and words missing on one side only are minor; a word in
    another's place is major, and so is a missing number or code.
    """
    code = [any(c.isdigit() for c in b) for b in y]
    rows = [(0, 0, j, 0) for j in range(len(y) + 1)]  # typing errors, missing in y, missing in x, major
    for i, a in enumerate(x, 1):
        code_a = any(c.isdigit() for c in a)
        diagonal, left = rows[0], (0, i, 0, 0)
        new = [left]
        for j, b in enumerate(y):
            above = rows[j + 1]
            t, p, q, m = diagonal
            if a != b:
                if _stands(a, b):
                    t += 1
                else:
                    m += 1
            cost = t + p + q + 1.5 * (p if p < q else q) + 3.5 * m
            t1, p1, q1, m1 = above
            if code_a:
                m1 += 1
            else:
                p1 += 1
            c = t1 + p1 + q1 + 1.5 * (p1 if p1 < q1 else q1) + 3.5 * m1
            if c < cost:
                cost, t, p, q, m = c, t1, p1, q1, m1
            t1, p1, q1, m1 = left
            if code[j]:
                m1 += 1
            else:
                q1 += 1
            if t1 + p1 + q1 + 1.5 * (p1 if p1 < q1 else q1) + 3.5 * m1 < cost:
                t, p, q, m = t1, p1, q1, m1
            left = (t, p, q, m)
            new.append(left)
            diagonal = above
        rows = new
    typos, in_x, in_y, major = rows[-1]
    both = min(in_x, in_y)
    return typos + max(in_x, in_y) - both, major + both


def people_match(a: list[str], b: list[str]) -> str:
    """``most``, ``some``, ``no`` or ``none`` (one list is empty): shared names in the shorter list, typing errors allowed."""
    if not a or not b:
        return "none"
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    rest = set(long)
    hits = sum(1 for x in short if x in rest or any(N.near(x, y) for y in long))
    return "most" if hits * 2 >= len(short) and hits else "some" if hits else "no"


def year_match(a: int | None, b: int | None) -> str:
    return "none" if a is None or b is None else "same" if a == b else "next" if abs(a - b) == 1 else "no"


def doi_match(a: str | None, b: str | None) -> str:
    return "none" if a is None or b is None else "same" if a == b else "no"


def _triples(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"\w+", re.sub(r"<[^<>]{1,40}>", " ", text).lower())
    return set(zip(w, w[1:], w[2:]))


def gist_match(a: str | None, b: str | None) -> str:
    """``same`` if two abstracts have three words in a row in common, ``no`` if not, ``none`` where too little is legible."""
    if not a or not b:
        return "none"
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 120 and short[40:100] in long:
        return "same"
    if short.count("?") * 15 > len(short) or long.count("?") * 15 > len(long):
        return "none"
    x, y = _triples(short), _triples(long)
    return "none" if min(len(x), len(y)) < 8 else "same" if x & y else "no"


COMPARED = "a long, b long, title string, plain boolean, tag boolean, people string, year string, doi string, gist string"


def compared(cands: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """COMPARED of each candidate pair: how the two forms agree. ``plain``: a title of fewer than four content words.

    Forms with a column ``text`` are compared by it too, where title and people alone would join them.
    """
    cols = ["title", "cut", "tag", "people", "year", "doi"] + (["text"] if "text" in left.columns else [])
    pick = lambda df, k: df.select(F.col("no").alias(k), F.struct(*cols).alias(f"f{k}"))
    joined = cands.join(pick(left, "a"), "a").join(pick(right, "b"), "b").select("a", "b", "fa", "fb")

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                t = title_match(x["title"], y["title"], x["cut"], y["cut"])
                n = min(sum(w not in STOP for w in f["title"].split()) for f in (x, y))
                g = gist_match(x["text"], y["text"]) if t != "other" and "text" in x else "none"
                out.append((a, b, t, n < 4, x["tag"] == y["tag"], people_match(x["people"], y["people"]), year_match(x["year"], y["year"]), doi_match(x["doi"], y["doi"]), g))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in COMPARED.split(", ")]
            )

    return joined.mapInArrow(run, COMPARED)


def rule() -> Column:
    """Which rule makes two compared records one paper: ``clear``, ``begun``, ``plain``, ``doi``, or ``no``."""
    t, p, y, d = (F.col(c) for c in ("title", "people", "year", "doi"))
    close = t.isin("same", "near")
    clear = close & ~F.col("plain") & ((p != "no") | (d == "same") | (y == "same"))
    begun = (t == "part") & (p.isin("most", "some") | (d == "same") | ((p == "none") & y.isin("same", "next")))
    plain = close & F.col("plain") & ((d == "same") | ((p == "most") & (y != "no") & (d != "no")))
    by_doi = (d == "same") & ((t.isin("word", "none") & (p != "no")) | ((t == "other") & (p == "most") & y.isin("same", "next")))
    named = F.when(clear, "clear").when(begun, "begun").when(plain, "plain").when(by_doi, "doi")
    apart = (F.col("gist") == "no") & (d != "same")  # two abstracts without a common phrase
    return F.when(F.col("tag") & ~apart, F.coalesce(named, F.lit("no"))).otherwise("no")


def is_same() -> Column:
    return rule() != "no"
