"""Scope of questions, the tools' facade, the stored index and the smaller evidence operators."""

import pytest
from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.operators import evidence, index, scope, store, survey
from paperlake.plans import facade
from paperlake.sources import pdf, services


def test_scope(spark):
    papers = spark.createDataFrame(
        [("p1", "Deep learning for cells", "https://doi.org/10.1234/AB", 1), ("p2", "Growth of rocks and stars", None, 2), ("p3", None, "10.1234/ab", 3)],
        "paper_id string, title string, doi string, ord int",
    )
    q = spark.createDataFrame(
        [(1, 'see "growth of rocks in space" and 10.1234/ab.'), (2, "nothing here"), (3, '"Deep Learning for Cells" please'), (4, '"wholly unrelated thing"')],
        "qid int, q string",
    )
    got = {r.qid: (r.forced, r.max_papers, r.moderate) for r in scope.resolved(q, papers, "qid", "q").collect()}
    assert got == {1: (["p1", "p2"], 2, 1), 2: ([], 5, 0), 3: (["p1"], 1, 0), 4: ([], 5, 0)}


def test_facade(spark, tmp_path):
    bib = tmp_path / "a.bib"
    bib.write_text('@article{a, title={Cells}, abstract={about living cells}, year=2020}\n@article{b, title={Stars}, abstract={about bright stars}}\n')
    model = connectors.EchoModel([("stars", "Stars [1][7].")])
    t = facade.Tools(spark, store.Store(spark, str(tmp_path / "kb")), connectors.HashingEmbedder(), model, connectors.TableFetcher({"d": "x"}), 50, 10)
    assert t.list_knowledge_bases().count() == 0
    assert t.create_knowledge_base("my kb", str(bib)) == 2
    with pytest.raises(ValueError):
        t.create_knowledge_base("my kb")
    with pytest.raises(ValueError):
        t.create_knowledge_base("!!")
    assert [tuple(r) for r in t.list_knowledge_bases().select("kb_name", "papers").collect()] == [("my_kb", 2)]
    papers = spark.createDataFrame([("new", "Rocks", "A", 2000, None, "about rocks", None, "x")] * 2, "paper_id string, title string, authors string, year int, doi string, abstract string, full_text string, source string")
    assert t.add_papers_to_kb("my_kb", papers) == 1 and t.add_papers_to_kb("my_kb", papers) == 0
    q = spark.createDataFrame([(1, "about bright stars")], "qid long, q string")
    top = t.search_knowledge_base("my_kb", q).orderBy("place").first()
    assert "Stars" in t.store.read("my_kb").where(F.col("paper_id") == top.paper_id).first().chunk
    assert t.generate_report("my_kb", q).first().answer == "Stars [1]."
    assert t.get_paper_content(spark.createDataFrame([("d",)], "doi string")).first().content == "x"
    assert "search_knowledge_base" in t.get_info()["tools"] and t.delete_knowledge_base("my_kb")


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cells grow"), (2, "rocks and cells"), (3, "stars"), (4, None)], "id long, t string")
    q = spark.createDataFrame([(1, "cells stars")], "qid long, q string")
    s = store.Store(spark, str(tmp_path))
    index.saved(s, "k", docs, "id", "t")
    a = {(r.qid, r.id): r.score for r in index.scored(docs, "id", "t", q, "qid", "q").collect()}
    b = {(r.qid, r.id): r.score for r in index.scored_stored(s, "k", "id", q, "qid", "q").collect()}
    assert a == pytest.approx(b) and len(a) == 3


def test_web_results(spark):
    rows = [(1, '[{"content": "a", "url": "u"}, {"snippet": "b", "title": "t"}, {"x": 1}]'), (2, '{"results": [{"text": "c"}]}'), (3, "plain"), (4, ""), (5, None), (6, "{bad"), (7, '{"body": "d"}')]
    got = sorted((r.k, r.content, r.citation, r.url) for r in evidence.web_results(spark.createDataFrame(rows, "k int, r string"), "k", "r").collect())
    w = "Web search"
    assert got == [(1, "a", w, "u"), (1, "b", "t", ""), (2, "c", w, ""), (3, "plain", w, ""), (6, "{bad", w, ""), (7, "d", w, "")]


def test_small_operators(spark):
    h = spark.createDataFrame([("q", "t", False, 1), ("q", "t", False, 2), ("q", "w", True, 3), ("q", "w", True, 4)], "g string, title string, web boolean, pos int")
    assert [r.pos for r in evidence.bypassing(h, "g", "pos", F.col("web"), 9).orderBy("place").collect()] == [1, 3, 4]
    p = spark.createDataFrame([("x" * 500, None, 1), (None, "y" * 300, 2), ("x", "y" * 450, 3), ("x", "y", 4)], "full_text string, abstract string, pos int")
    assert [r.pos for r in evidence.for_extraction(p, "pos").orderBy("pos").collect()] == [1, 3]
    a = evidence.accuracy(spark.createDataFrame([("a", "a"), ("a", "b")], "p string, e string"), "p", "e").first()
    assert (a.n, a.accuracy) == (2, 0.5)
    names = spark.createDataFrame([("t1", 1), ("t2", 2)], "theme string, ord int")
    papers = spark.createDataFrame([(1,), (2,)], "pid long")
    none = spark.createDataFrame([], "pid long, theme string")
    assert {tuple(r) for r in survey.assigned_or_first(papers, none, names).collect()} == {(1, "t1"), (2, "t1")}
    some = spark.createDataFrame([(1, "t2")], "pid long, theme string")
    assert [tuple(r) for r in survey.assigned_or_first(papers, some, names).collect()] == [(1, "t2")]
    assert survey.default_themes(spark, "soil", spark.createDataFrame([], "concepts array<string>")).count() == 3


def test_service_routes(spark):
    f = spark.createDataFrame([("10.1021/acs.1", None, None, None, "https://arxiv.org/abs/2101.12345"), ("10.5/x", "http://o", None, "http://u", None)], "doi string, oa_url string, arxiv_id string, unpaywall_pdf_url string, url string")
    got = {d: [r.source for r in services.pdf_chain(f).where(F.col("doi") == d).orderBy("priority").collect()] for d in ("10.1021/acs.1", "10.5/x")}
    assert got == {"10.1021/acs.1": ["arxiv_pdf", "openalex_oa_pdf", "acs_pdf"], "10.5/x": ["publisher_oa_pdf", "unpaywall_pdf", "openalex_oa_pdf"]}
    q = spark.createDataFrame([("see https://arxiv.org/abs/2101.12345.",), ("https://doi.org/10.1234/ab)",), ("http://x.org",), ("none",)], "q string")
    assert [r[0] and tuple(r[0]) for r in q.select(services.address_kind(F.col("q"))).collect()] == [("arxiv", "2101.12345"), ("doi", "10.1234/ab"), ("web", "http://x.org"), None]
    c = spark.createDataFrame([("10.1/a", '{"title": ["T"], "author": [{"given": "A", "family": "B"}], "published-print": {"date-parts": [[2020, 1]]}, "container-title": ["J"]}'), ("10.1/b", "{}")], "doi string, json string")
    r = services.crossref_papers(c).collect()
    assert len(r) == 1 and (r[0].title, r[0].year, r[0].journal, r[0].authors[0].name) == ("T", 2020, "J", "A B")


def test_pdf(spark):
    rows = [("a", bytearray(b"%PDF" + b"x" * 1000)), ("b", bytearray(b"word " * 300)), ("c", bytearray(b"x")), ("d", None), ("e", bytearray(b"\xff" * 2000))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.text, r.error) for r in pdf.read(df, "path", "content", lambda c: ["p" * 150, "", "q" * 100]).collect()}
    assert got["a"] == ("p" * 150 + "\n\n" + "q" * 100, None) and got["b"][0].startswith("word") and all(got[k][0] is None and got[k][1] for k in "cde")
