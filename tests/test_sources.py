"""Readers of bibliographies, markup and service records; streams and the engine with stand-ins."""

import json

from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.plans import engine
from paperlake.sources import bibtex, markup, services
from paperlake.streaming import events

BIB = """% a comment
@article{k1, title = {The {DNA} of "x"}, author = "Doe, John and Jane Smith and Plato", year = 2024, doi = {https://doi.org/10.1/A},
 keywords = {a, b}, note = {n} }
@misc{, title = {No key}, date = "2020-05-01", journaltitle = {J}}
@string{x = "y"}
@broken{z, title = {open
@book{k3, title = {After}}
@online{k4, title = {Not a paper type}}
@article{k5, title = { }}
"""
JATS = """<article><front><abstract><p>Short abstract.</p></abstract></front><body><sec><title>Intro</title><p>Some <i>intro</i> text</p>
<sec><title>Sub</title><p>Inner</p></sec></sec></body><back><ref-list><ref><mixed-citation><name><surname>Doe</surname><given-names>J</given-names></name>
<article-title>T</article-title><source>S</source><year>2020</year><ext-link xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="https://doi.org/10.1/x">l</ext-link></mixed-citation></ref>
<ref><element-citation>plain text <pub-id pub-id-type="doi">10.2/y</pub-id></element-citation></ref></ref-list></back></article>"""


def test_bibtex(spark, tmp_path):
    rows = bibtex.entries(spark.createDataFrame([(1, BIB), (2, None)], "id int, t string"), "t", "id")
    keys = [r.key for r in rows.collect()]
    assert keys[:2] == ["k1", ""] and "k3" in keys and "k4" in keys
    p = {r.title: r for r in bibtex.papers(bibtex.normalized(rows)).collect()}
    a = p['The DNA of "x"']
    assert a.id == "doi:10.1/a" and a.year == 2024 and a.keywords == ["a", "b"] and a.metadata == {"note": "n"}
    assert [(x.name, x.given, x.family) for x in a.authors] == [("John Doe", "John", "Doe"), ("Jane Smith", "Jane", "Smith"), ("Plato", None, None)]
    assert p["No key"].year == 2020 and p["No key"].journal == "J" and p["No key"].id.startswith("generated:")
    assert set(p) == {'The DNA of "x"', "No key", "After"}
    (tmp_path / "a.bib").write_text(BIB)
    spark.dataSource.register(bibtex.BibtexSource)
    assert spark.read.format("bibtex").load(str(tmp_path)).count() == len(keys)
    assert bibtex.scan(spark, str(tmp_path / "a.bib")).count() == len(keys)


def test_local_pdf(spark):
    df = spark.createDataFrame([("{Desc:/a/b.PDF:application/pdf}",), ("/c/d.pdf",), ("x",)], "f string")
    assert [r[0] for r in df.select(bibtex.local_pdf(F.col("f"))).collect()] == ["/a/b.PDF", "/c/d.pdf", None]


def test_html(spark):
    page = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><article><h1>H</h1><p>one  two</p><script>z</script></article>tail</body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, " "), (4, "<h1>A</h1> <p>b")], "id int, h string")
    got = {r.id: (r.title, r.text) for r in markup.html_text(df, "id", "h").collect()}
    assert got == {1: ("T", "H\none\ntwo"), 2: (None, None), 3: (None, None), 4: ("A", "A\nb")}
    assert markup.html_sections("<h2>S</h2><p>" + "x" * 60 + "</p><h2>E</h2><p>y</p>") == [{"ord": 0, "section": "S", "content": "x" * 60}]


def test_jats(spark):
    df = spark.createDataFrame([(1, JATS), (2, "<a"), (3, None)], "id int, x string")
    got = [(r.section, r.content) for r in markup.article_sections(df, "id", "x").collect()]
    assert got == [("Intro", "Some intro text"), ("Intro > Sub", "Inner"), ("Abstract", "Short abstract.")]
    refs = markup.article_references(df, "id", "x").collect()
    assert (refs[0].doi, refs[0].title, refs[0].authors) == ("10.1/x", "T", ["J Doe"]) and refs[1].doi == "10.2/y" and refs[1].text.startswith("plain text")
    assert [r.text for r in markup.article_text(df, "id", "x").collect()] == [None] * 3
    assert markup.jats_text(f"<article><body><p>{'x ' * 150}</p></body></article>").startswith("x x")


def test_services(spark):
    inv = {"Test": [0], "abstract": [1], "text": [2, 5], "for": [3]}
    df = spark.createDataFrame([(inv,), ({},)], "i map<string,array<int>>")
    rows = df.select(services.inverted_abstract(F.col("i")), services.inverted_abstract_gaps(F.col("i"))).collect()
    assert tuple(rows[0]) == ("Test abstract text for text", "Test abstract text for  text") and rows[1][0] is None
    work = {"title": "W", "open_access": {"is_oa": True, "oa_url": ""}, "ids": {"pmcid": "https://x/PMC12"}, "doi": "10.48550/arXiv.2101.1", "abstract_inverted_index": {"a": [0]}}
    pay = {"is_oa": False, "best_oa_location": {"url_for_pdf": "http://p.pdf", "url": "http://u"}, "oa_locations": []}
    d = services.discovery(spark.createDataFrame([("10.1/a", json.dumps(work), json.dumps(pay))], "doi string, work string, unpaywall string")).first()
    assert (d.is_oa, d.oa_url, d.pmcid, d.arxiv_id, d.abstract, d.unpaywall_pdf_url) == (True, "http://u", "PMC12", "2101.1", "a", "http://p.pdf")
    c = spark.createDataFrame([("d", "abstract", "x" * 30), ("d", "pmc", "y" * 201), ("e", "pmc", "short"), ("f", "abstract", "x" * 30)], "doi string, source string, text string")
    assert {r.doi: r.content_type for r in services.best_content(c).collect()} == {"d": "structured", "e": "none", "f": "abstract"}
    z = spark.createDataFrame([(1, "T", "Doe, John; Smith, Jane", "2024-01-02", "", "J", "", "", 3, None)], "record_no long, title string, author string, date_text string, doi string, publication_title string, abstract_note string, url string, citation_count int, api_source string")
    r = services.zotero_papers(z).first()
    assert len(r.authors) == 2 and r.authors[0].family == "Doe" and r.year == 2024
    b = spark.createDataFrame([(bytearray(b"%PDF" + b"\xff" * 1000),), (bytearray(b"a" * 1000),), (bytearray(b"\xff" * 2000),), (bytearray(b"x"),)], "b binary")
    assert [x[0] for x in b.select(services.pdf_bytes_ok(F.col("b"))).collect()] == [True, True, False, False]


def test_zotero_authors_with_and(spark, tmp_path):
    from paperlake.plans import registry

    names = ["Doe, John; Institute of Ice and Light", "Doe, John and Smith, Jane", "Doe, John;Smith, Jane ; ", "Cher", None, ""]
    rows = [(i, "T", a, "2024-01-02", "", "J", "", "", 3, None) for i, a in enumerate(names)]
    kinds = "record_no long, title string, author string, date_text string, doi string, publication_title string, abstract_note string, url string, citation_count int, api_source string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/search_records.parquet")
    want = {i: len([p for p in (a or "").replace("; ", ";").split(";") if p.strip()]) for i, a in enumerate(names)}
    assert {r.record_no: r.n_authors for r in registry.QUERIES["zotero_map"](spark, str(tmp_path)).collect()} == want
    z = services.zotero_papers(spark.createDataFrame(rows[:1], kinds)).first()
    assert [a.name for a in z.authors] == ["John Doe", "Institute of Ice and Light"]


def test_connectors(spark):
    df = spark.createDataFrame([(1, "cell growth"), (2, ""), (3, None)], "id int, t string")
    v = connectors.embedded(df, "t", connectors.HashingEmbedder(8)).orderBy("id").collect()
    assert len(v[0].embedding) == 8 and set(v[1].embedding) == {0.0} == set(v[2].embedding)

    class Broken:
        def complete(self, prompts):
            raise ValueError

    assert [r.answer for r in connectors.completed(df, "t", Broken()).collect()] == [None] * 3
    got = connectors.fetched(spark.createDataFrame([("a",), ("b",), ("a",)], "doi string"), "doi", connectors.TableFetcher({"a": "x"}))
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("b", None)]


def test_streams(spark, tmp_path):
    a = spark.createDataFrame([("s", "ä" * 250), ("t", None)], "session string, answer string")
    got = {r.session: (r.answer, r.finished) for r in events.collected(events.answer_events(a, "session", "answer")).collect()}
    assert got == {"s": ("ä" * 250, True), "t": ("", True)}
    src, out = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate(([("1", "a"), ("1", "b")], [("1", "c"), ("2", "d")])):
        spark.createDataFrame(rows, "id string, t string").coalesce(1).write.parquet(str(src / str(n)))
        stream = spark.readStream.schema("id string, t string").option("recursiveFileLookup", "true").parquet(str(src))
        events.ingest(stream, "id", out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_engine(spark):
    rows = [(i, f"Title {i}", "A", 2020, None, f"abstract about {w}", f"{w} " * 30, f"src{i % 2}") for i, w in enumerate(["cells", "stars", "rocks"])]
    papers = spark.createDataFrame(rows, "paper_id long, title string, authors string, year int, doi string, abstract string, full_text string, source string")
    emb = connectors.HashingEmbedder()
    chunks = engine.built(papers, emb, 20, 5).persist()
    e = engine.Engine(chunks, emb, connectors.EchoModel([("stars", "Stars [1] and [9].")]))
    q = spark.createDataFrame([(1, "stars")], "qid long, q string")
    for mode in ("basic", "advanced", "profound", "agentic", "survey", "odd"):
        top = e.query(mode, q).orderBy("place").first()
        assert top.paper_id == 1, mode
    assert "stars stars" in e.basic(q).orderBy("place").first().full_text
    assert e.answered("basic", q).first().answer.startswith("Stars [1] and")
