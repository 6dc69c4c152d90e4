"""Registered queries over the driver's smallest tables, against DuckDB or a plain reading of the same rows."""

import importlib
import os
import re

import pytest
from pyspark.sql import functions as F

from paperlake import session
from paperlake.functions import text as T
from paperlake.operators import chunking, evidence
from paperlake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _value(v):
    import datetime as dt
    import math

    import numpy as np

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, np.ndarray)):
        return [_value(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v if isinstance(v, (str, bool)) else int(v) if isinstance(v, (int, np.integer)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    have = sorted((repr([_value(r[c]) for c in cols]) for r in got.collect()))
    found = db.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([_value(dict(zip(names, r))[c]) for c in cols]) for r in found.fetchall())
    assert have == want and (have or name in ("article_types", "cache_lookup", "chunk_page"))  # no such rows in the smallest tables


def _texts(spark):
    return {r.doc_id: r.text for r in session.table(spark, SF, "documents").collect()}


def _run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_sentences(spark):
    """Against a scan of the characters."""

    def plain(t):
        out, held = [], []
        for line in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            parts, start = [], 0
            line = line.strip()
            for m in re.finditer(r"\s+", line):
                if m.start() and line[m.start() - 1] in ".!?":
                    parts.append(line[start : m.start()])
                    start = m.end()
            for s in filter(None, (p.strip() for p in [*parts, line[start:]])):
                if len(s) >= 40:
                    out += ([" ".join(held)] if held else []) + [s]
                    held = []
                else:
                    held.append(s)
                    if len(held) == 2:
                        out.append(" ".join(held))
                        held = []
        return out + ([" ".join(held)] if held else [])

    got = {}
    for r in sorted(_run(spark, "sentence_split"), key=lambda r: (r.doc_id, r.sentence_index)):
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {k: s for k, t in _texts(spark).items() if (s := plain(t))}


def test_sections_cover_the_text(spark):
    """Every line outside headers and reference lists is in one section, in order."""
    header, refs = re.compile(chunking.SECTION), re.compile(chunking.REFERENCES)
    want = {}
    for k, t in _texts(spark).items():
        held, name, out = [], "_full", []
        for line in re.split(r"\r\n|\n|\r", t or ""):
            if header.match(line.strip()):
                out.append((name, "\n".join(held).strip()))
                held, name = [], line.strip()
            else:
                held.append(line)
        out.append((name, "\n".join(held).strip()))
        if out := [x for x in out if x[1] and not refs.match(x[0])]:
            want[k] = out
    docs = session.table(spark, SF, "documents").where("text IS NOT NULL")
    got = {}
    for r in chunking.sections(docs, "doc_id", "text").orderBy("doc_id", "section_index").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.content))
    strange = {k for k, t in _texts(spark).items() if t and re.search(r"[\x1c-\x1f\x85  -​　]", t)}  # Java's white space is ASCII only
    assert {k: v for k, v in got.items() if k not in strange} == {k: v for k, v in want.items() if k not in strange} and len(got) > 50


def test_paragraphs_lose_nothing(spark):
    texts = _texts(spark)
    got = {}
    for r in sorted(_run(spark, "chunk_paragraphs"), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert len(got) > 50
    for k, parts in got.items():
        paras = [p.strip() for p in re.split(r"\n\s*\n", texts[k]) if p.strip()]
        seen = [p.strip() for c in parts for p in c.split("\n\n") if p.strip()]
        if not re.search(r"[\x1c-\x1f\x85  -​　\r\x0b\x0c]", texts[k]):
            assert set(paras) <= set(seen) | {q for p in paras for q in [p] if "\n\n" in p}


def test_semantic_chunks_keep_all_sentences(spark):
    texts = _texts(spark)
    got = {}
    for r in sorted(_run(spark, "chunk_semantic"), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert len(got) > 50
    for k, parts in got.items():
        assert " ".join(parts).split() == " ".join(chunking.sentence_list(texts[k])).split()


def test_citation_rewrites(spark):
    """Every mark left points to a paper there is, and nothing but marks and doubled spaces is gone."""
    for a, n in [("See [1, 9] and [7].", 2), ("[2][3]  x", 3), ("none", 5), ("", 1), ("[0] [1,2]", 1)]:
        out = evidence.verified_text(a, n)
        assert all(1 <= int(x) <= n for g in re.findall(r"\[(\d+(?:\s*,\s*\d+)*)\]", out) for x in g.split(","))
        bare = lambda t: re.sub(r"\[\d+(?:\s*,\s*\d+)*\]|\s", "", t)
        assert bare(out) == bare(a)
    assert evidence.compact_text("a [3] b [7, 3]", [3, 7]) == "a [1] b [2, 1]"


def test_scope_title(spark):
    """Against all pairs of quoted titles and titles."""
    p = session.table(spark, SF, "papers").select("paper_no", "title").where("title IS NOT NULL")
    asked = p.where("paper_no % 100 = 0").select(F.col("paper_no").alias("qid"), F.explode(T.quoted(F.concat(F.lit('What does "'), "title", F.lit('" say about x')))).alias("said"))
    all_ = asked.crossJoin(p).select("qid", "paper_no", T.title_match(T.normalized(F.col("said")), T.normalized(F.col("title"))).alias("s"))
    best = all_.groupBy("qid").agg(F.max("s").alias("s"))
    want = {r.qid: round(r.s, 6) for r in best.collect()}
    got = {}
    for r in _run(spark, "scope_title"):
        got[r.qid] = max(got.get(r.qid, 0), r.score)
    assert got and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)


@pytest.mark.parametrize("mode", ["basic", "advanced", "profound", "agentic", "survey"])
def test_modes(spark, mode):
    """The best paper of basic retrieval is the one all vectors give; every mode has places from 1 without gaps and whole texts."""
    rows = _run(spark, f"mode_{mode}")
    by = {}
    for r in rows:
        by.setdefault(r.qid, []).append(r)
    assert by
    texts = _texts(spark)
    for q, found in by.items():
        assert sorted(r.place for r in found) == list(range(1, len(found) + 1)) and len({r.paper_id for r in found}) == len(found)
        assert all(r.chars == len(" ".join(re.split(r"[ \t\n\x0b\f\r]+", texts[r.paper_id].strip(" \t\n\x0b\f\r")))) or mode == "survey" for r in found if r.chars and len(texts[r.paper_id].split()) < 180)
    if mode == "basic":
        from paperlake.connectors import HashingEmbedder

        e = HashingEmbedder()
        titles = {r.paper_no: r.title for r in session.table(spark, SF, "papers").where("paper_no % 100 = 0").collect()}
        chunks = [(k, " ".join(w[i : i + 200])) for k, t in texts.items() if t for w in [[x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]] for i in range(0, len(w), 180)]
        vecs = e.embed([c for _, c in chunks])
        for q, found in by.items():
            top = max(1 / (1 + max(0.0, 1 - float(v @ e.embed([titles[q]])[0]))) for v in vecs)
            assert max(r.score for r in found) == pytest.approx(top, abs=1e-4)


def test_kb_pipeline(spark):
    rows = _run(spark, "kb_pipeline")
    papers = {r.paper_no: r for r in session.table(spark, SF, "papers").collect()}
    ok = {k for k, p in papers.items() if (p.full_text or "").strip() or ((p.abstract or "").strip() and "no abstract available" not in p.abstract.lower())}
    assert {r.paper_id for r in rows} == ok and len({(r.paper_id, r.chunk_index) for r in rows}) == len(rows) == len({r.id for r in rows})
    assert all(r.dim == 64 for r in rows)


def test_pdf_chain(spark):
    rows = _run(spark, "pdf_chain")
    assert rows
    assert {r.source for r in rows} >= {"publisher_oa_pdf", "openalex_oa_pdf"}


def test_entry():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
