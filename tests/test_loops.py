"""Research loops with a model of fixed answers."""

import json

import pytest

from paperlake import connectors
from paperlake.operators import chunking, evidence
from paperlake.plans import engine, loops

TEXTS = {"p1": "living cells grow in light", "p2": "bright stars shine at night", "p3": "rocks erode in rain", "p4": "cells divide in the dark"}


def model(*rules):
    return connectors.EchoModel([(p, a if isinstance(a, str) else json.dumps(a)) for p, a in rules])


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, p, 0, t, p) for i, (p, t) in enumerate(TEXTS.items())]
    df = spark.createDataFrame(rows, "id long, paper_id string, chunk_index int, chunk string, source string")
    return connectors.embedded(df, "chunk", connectors.HashingEmbedder()).persist()


def made(chunks, *rules):
    return engine.Engine(chunks, connectors.HashingEmbedder(), model(*rules))


def test_rewritten(spark):
    q = spark.createDataFrame([(1, "and its size?"), (2, "stars"), (3, "x y z"), (4, "same")], "qid long, q string")
    h = spark.createDataFrame([(1, "Recent conversation:\nUser: cells"), (3, "User: a"), (4, "User: b"), (2, "")], "qid long, block string")
    m = model(("its size", " size of cells "), ("x y z", "ab"), ("same", "same"))
    got = {r.qid: (r.q, r.refined) for r in loops.rewritten(q, h, m).collect()}
    assert got == {1: ("size of cells", "size of cells"), 2: ("stars", None), 3: ("x y z", None), 4: ("same", None)}


def test_refined(spark):
    a = spark.createDataFrame([(1, "q1", "c", "bad"), (2, "q2", "c", "fine"), (3, "q3", None, "odd"), (4, "q4", "c", None)], "qid long, q string, context string, answer string")
    m = model((r"(?s)^Judge.*\n\nfine", {"overall_score": 9}), (r"(?s)^Judge.*\n\nbad", {"overall_score": 2, "feedback": "more"}), (r"(?s)^Judge.*q3", "no idea"),
              (r"(?s)^Judge.*q4", {"feedback": "?"}), (r"(?s)^Improve.*bad", "fine"), (r"(?s)^Improve", " "))
    got = {r.qid: (r.answer, r.score, r.rounds) for r in loops.refined(a, m, 2).collect()}
    assert got == {1: ("fine", 9.0, 2), 2: ("fine", 9.0, 1), 3: ("odd", 5.0, 2), 4: (None, 0.0, 2)}
    assert loops.refined(a.where("qid > 9"), m).count() == 0


def test_cascade(spark, chunks):
    q = spark.createDataFrame([(1, "living cells"), (2, "bright stars"), (3, "deep sea"), (4, "lost")], "qid long, q string")
    e = made(chunks, (r"(?s)suffice.*Question: living", {"sufficient": True}), (r"(?s)suffice.*Question: bright", {"sufficient": False, "missing_aspects": ["m"]}),
             ("(?s)Context.*bright", {"queries": ["night stars", "stars shine"]}), ("suffice", "no JSON"), ("Context", "none"))
    docs, ends = loops.cascade(e, q, connectors.TableFetcher({"deep sea": json.dumps([{"content": f"w{i}"} for i in range(5)])}))
    got = {r.qid: (r.success, r.stage) for r in ends.collect()}
    assert got == {1: (True, 1), 2: (False, 0), 3: (True, 3), 4: (False, 0)}
    of = lambda k: sorted((r.place, r.full_text) for r in docs.where(f"qid = {k}").collect())
    assert of(1)[0][1] == TEXTS["p1"] and [t for _, t in of(3)][-3:] == ["w0", "w1", "w2"] and of(2) == of(4) == []
    docs, ends = loops.cascade(made(chunks, ("suffice", "?")), q)
    assert {r.stage for r in ends.collect()} == {0} and docs.count() == 0


def test_second_stage(spark, chunks):
    q = spark.createDataFrame([(1, "bright stars")], "qid long, q string")

    class Later:
        """Documents suffice from the second look on: the first is at the question's own order of papers."""

        def complete(self, prompts):
            return [json.dumps({"sufficient": "[1] cells" in p, "missing_aspects": ["cells"]}) if "suffice" in p else json.dumps({"queries": ["cells divide dark", "cells dark"]}) for p in prompts]

    docs, ends = loops.cascade(engine.Engine(chunks, connectors.HashingEmbedder(), Later()), q)
    assert [(r.success, r.stage) for r in ends.collect()] == [(True, 2)] and docs.where("place = 1").first().paper_id == "p4"


def test_profound(spark, chunks):
    q = spark.createDataFrame([(1, "living cells"), (2, "lost things"), (3, "odd"), (4, "bright stars")], "qid long, q string")
    e = made(
        chunks,
        ("(?s)Plan the.*living", {"plan": ["a", "b"], "queries": ["living cells", "never asked"]}),
        ("(?s)Plan the.*lost", {"plan": ["a", "b", "c"], "queries": ["lost one", "lost two", "lost three"]}),
        ("(?s)Plan the.*odd", {"plan": ["a", "b", "c"], "queries": ["odd one", "odd two", "odd three"]}),
        ("(?s)Plan the", "no plan"),
        ("(?s)answered.*Question: living", {"answered": True, "confidence": 0.9}), ("(?s)Is the question answered", {"answered": True, "confidence": 0.2}),
        ("(?s)Review.*lost", {"should_complete": True, "question_type": "unanswerable"}), ("(?s)Review.*odd", {"plan": ["n"], "queries": ["bright stars"]}),
        ("(?s)suffice.*(?:lost|odd)", "no"), ("suffice", {"sufficient": True}), ("Context", "none"),
    )
    docs, ends = loops.profound(e, q, cycles=1)
    got = {r.qid: (r.reason, r.steps, r.cycles) for r in ends.collect()}
    assert got == {1: ("question_answered", 1, 1), 2: ("unanswerable", 2, 1), 3: ("plan_complete", 3, 1), 4: ("plan_complete", 1, 1)}
    assert {(r.qid, r.step) for r in docs.select("qid", "step").distinct().collect()} == {(1, 0), (3, 2), (4, 0)}
    _, ends = loops.profound(e, q.where("qid = 4"), cycles=2)
    assert [(r.reason, r.steps, r.cycles) for r in ends.collect()] == [("plan_complete", 2, 2)]
    docs, ends = loops.profound(e, q.where("qid > 9"))
    assert docs.count() == 0 and ends.count() == 0


def test_extracted(spark):
    q = spark.createDataFrame([(1, "how do cells grow?"), (2, "none")], "qid long, q string")
    rows = [(1, 1, "A", "cells " * 100, None), (1, 2, "B", None, "short " * 50), (1, 3, "C", "x", "y" * 450), (1, 4, "D", "zz" * 300, None), (2, 1, "E", "a", "b")]
    p = spark.createDataFrame(rows, "qid long, place int, title string, full_text string, abstract string")
    m = model((r"Paper \[1\]", "- they grow"), (r"Paper \[4\]", "(no relevant content for this question)"), (r"Paper \[3\]", "- y"))
    got = {r.qid: r.notes for r in loops.extracted(q, p, m).collect()}
    assert got == {1: "### Paper [1] A\n- they grow"}  # a full text of one letter stands before the abstract


def test_by_address(spark):
    rows = [(1, "see https://arxiv.org/abs/2101.12345v2"), (2, "https://doi.org/10.1/ab"), (3, "https://doi.org/10.1234/xy"), (4, "http://x.org"), (5, "no address"), (6, "https://doi.org/10.1234/gone")]
    q = spark.createDataFrame(rows, "qid long, q string")
    j = json.dumps
    pages = connectors.TableFetcher({"2101.12345": j({"full_text": "T"})})
    contents = connectors.TableFetcher({"10.1234/xy": j({"title": "no text"})})
    scholar = connectors.TableFetcher({"10.1234/xy": j({"title": "S", "abstract": "a", "doi": "10.1234/XY"})})
    got = {r.qid: (r.title, r.doi, r.full_text, r.source, r.relevance) for r in loops.by_address(q, pages, contents, scholar).collect()}
    assert got == {1: ("arXiv:2101.12345", "10.48550/arXiv.2101.12345", "T", "url_fetch", 5), 3: ("S", "10.1234/XY", None, "semantic_scholar_fallback", 4)}


def test_survey(spark):
    rows = [(f"p{i}", i, f"Title {i}", "A", f"about {'cells' if i % 2 else 'stars'} {i}" if i else None, 2015 + i % 10, None, i) for i in range(30)]
    p = spark.createDataFrame(rows, "pid string, pos int, title string, authors string, abstract string, year int, doi string, citations int")

    class Reader:
        def complete(self, prompts):
            import re

            out = []
            for x in prompts:
                if x.startswith("Analyse"):
                    out.append(json.dumps({"analyses": [{"paper_id": i, "relevance_score": 4 if int(i[1:]) % 3 else 1, "key_concepts": ["cells", "light"]} for i in re.findall(r"ID: (p\d+)", x)] + [{"paper_id": "foreign"}]}))
                elif x.startswith("Name"):
                    assert "cells, light" in x
                    out.append('Themes: {"themes": [{"name": "Cells", "description": "c"}, {"name": "Stars", "description": "s"},]}')
                else:
                    out.append("Cells, Moon" if "about cells" in x else "None")
            return out

    got = loops.surveyed(p, "life", Reader(), 2024, most=12)
    assert got["analyses"].count() == 29 and [r.theme for r in got["themes"].orderBy("ord").collect()] == ["Cells", "Stars"]
    assert {(r.pid, r.theme) for r in got["assigned"].collect()} == {(f"p{i}", "Cells") for i in range(1, 30, 2)}
    picked = got["picked"].orderBy("place").collect()
    assert len(picked) == 12 and picked[0].pid == "p29" and got["report"].first().report.count("\n") == 11
    none = loops.surveyed(p.where("pos < 0"), "life", Reader(), 2024)
    assert none["themes"].count() == 3 and none["picked"].count() == 0


def test_searched(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, q string")
    shape = "qid long, pos int, title string, doi string, citations int"
    one = spark.createDataFrame([(1, 0, "T", "10.1/A", 1), (1, 1, "U", None, None)], shape)
    two = spark.createDataFrame([(1, 0, "t2", "10.1/a ", 9), (1, 1, "u", "", 0), (1, 2, None, None, 0), (1, 3, None, None, 0)], shape)
    late = lambda asked: asked.select("qid").join(spark.createDataFrame([(2, 0, "late", None, 0), (1, 0, "never", None, 0)], shape), "qid")
    got = [(r.qid, r.title, r.rank) for r in loops.searched([lambda _: one, lambda _: two], q, late).orderBy("qid", "rank").collect()]
    assert got == [(1, "U", 1), (1, "t2", 2), (1, None, 3), (1, None, 4), (2, "late", 1)]


def test_agentic_chunks(spark):
    text = "First part is here. It says a lot of things. " * 3 + "Second part is there. It says other things."
    docs = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "unread words " * 4)], "id long, t string")
    m = model(("First part", {"spans": [{"start": 135, "end": 999}, {"start": 100, "end": 0}]}), ("unread", "sorry"))
    got = [(r.id, r.chunk_index, r.chunk) for r in chunking.chunker("agentic", m)(docs, "id", "t", 30, 0, 2).orderBy("id", "chunk_index").collect()]
    assert [x[:2] for x in got if x[0] == 1] == [(1, i) for i in range(len([x for x in got if x[0] == 1]))]
    assert " ".join(x[2] for x in got if x[0] == 1).split() == text.split() and [x[2] for x in got if x[0] == 4] == [("unread words " * 4).strip()]
    over = [r.chunk for r in chunking.agentic(docs.where("id = 1"), "id", "t", 30, 3, 2, model=m).orderBy("chunk_index").collect()]
    assert all(b.split()[:3] == a.split()[-3:] for a, b in zip(over, over[1:])) and len(over) > 1
    assert chunking.chunker("agentic") is chunking.word_windows and chunking.chunker("section_aware") is chunking.in_sections
    assert chunking.adapted(1000, 200) == (750, 150) and chunking.encoder("/nowhere")("a b") == ["a", "b"]


def test_prompt_block(spark):
    f = spark.createDataFrame([("g", "cells", "covered", 2), ("g", "rocks", "gap", 1)], "plan string, facet string, status string, ord int")
    e = spark.createDataFrame([("cells", i, f"T{i}", "10.1/x" if i == 9 else None, "e" * 400 if i == 9 else "") for i in range(10)], "facet string, pos int, title string, doi string, excerpt string")
    b = evidence.prompt_block(f, e, "facet", "pos", group="plan").first().block
    assert b.startswith("[GAP] Facet: rocks\n  (no evidence yet)\n\n[COVERED] Facet: cells\n  - T3\n") and b.endswith("T9 (DOI: 10.1/x)\n    " + "e" * 350)
    assert evidence.prompt_block(f, e, "facet", "pos", chars=10).first().block == b[:10] + "\n…"


def test_download_order(spark):
    rows = [(1, 5, "d", True), (2, 3, "d", False), (3, 2, "d", False), (4, 4, "", False), (5, 4, "d", None), (6, 3, "d", True)]
    p = spark.createDataFrame(rows, "pos int, relevance int, doi string, open_access boolean")
    assert [r.pos for r in evidence.download_order(p, "pos").orderBy("place").collect()] == [5, 2, 1, 6]


def test_small(spark, tmp_path):
    from pyspark.sql import functions as F

    from paperlake.functions import ids
    from paperlake.operators import conversation, retrieval, store

    z = spark.createDataFrame([(1, ["a", "b"], [0.5]), (2, [], [])], "qid int, ids array<string>, scores array<double>")
    assert [tuple(r) for r in retrieval.zipped(z, "ids", "scores").collect()] == [(1, 0, "a", 0.5), (1, 1, "b", None)]
    c = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 3)], "id string, updated_at int")
    assert [r.id for r in conversation.recent(c, 3).collect()] == ["b", "d", "a"]
    m = spark.createDataFrame([("c", 3), ("c", 1), ("c", 2)], "conv string, t int")
    assert sorted(r.t for r in conversation.opening(m, "conv", ["t"], 2).collect()) == [1, 2]
    n = spark.createDataFrame([(5, 7), (5, 8), (None, 1)], "a long, b int").select(ids.packed(F.col("a"), F.col("b")).alias("k"))
    assert [r.k for r in n.collect()] == [5 << ids.LOW_BITS | 7, 5 << ids.LOW_BITS | 8, None]
    with pytest.raises(Exception):
        spark.range(1).select(ids.packed(F.col("id"), F.lit(1 << ids.LOW_BITS))).collect()
    s = store.Store(spark, str(tmp_path))
    s.replace("k", spark.range(3))
    s.replace("k", spark.range(5))
    s.delete_ids("k", spark.range(2))
    assert s.read("k").count() == 3 and s.names() == ["k"]
    both = spark.createDataFrame([(1, "b", {"x": "y"}), (1, "a", None), (2, "c", None)], "k int, v string, m map<string,string>")
    assert sorted(r.v for r in store.first_seen(both, ["k"]).collect()) == ["a", "c"]
