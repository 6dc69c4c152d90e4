"""Golden values and properties of operators on small tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake.operators import chunking, conversation, evidence, index, retrieval, store, survey


def test_facets(spark):
    rows = [("one", 3, False)] + [("five", 3, False)] * 5 + [("ten", 3, False)] * 10 + [("r5", 5, False), ("r1", 1, False)]
    rows += [("ft", 3, True)] * 2 + [("third", 3, True), ("third", 3, False), ("third", 3, False), ("mix", 5, False), ("mix", 1, False)]
    e = spark.createDataFrame(rows, "facet string, relevance int, full_text boolean")
    names = spark.createDataFrame([(x,) for x in {r[0] for r in rows} | {"none"}], "facet string")
    got = {r.facet: (r.confidence, r.status) for r in evidence.facets(names, e, "facet").collect()}
    want = {"one": 0.265, "five": 0.625, "ten": 0.625, "r5": 0.44, "r1": 0.09, "ft": 0.555, "third": 0.5117, "mix": 0.355, "none": 0.0}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert (got["none"][1], got["ft"][1], got["third"][1]) == ("gap", "partial", "covered")


PAPERS = "pos long, id string, title string, doi string, full_text string, abstract string, citation_count int, year int"
LONG = "A very long title about the growth of cells in light"


def test_keep_best(spark):
    rows = [
        (0, None, "Paper A", "10.1/a", None, "short", None, None), (1, None, "Paper A (preprint)", "10.1/A", None, "much longer", None, None),
        (2, None, LONG, "10.1101/x", None, "same", 1, 2020), (3, None, LONG + "!", "10.1038/y", None, "same", 1, 2020),
        (4, None, "", "", None, None, None, None), (5, None, None, None, None, None, None, None), (6, "W1", None, None, None, None, None, None),
    ]
    got = evidence.keep_best(spark.createDataFrame(rows, PAPERS), "pos").select("pos", "first_pos").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (3, 2), (6, 6)]
    again = evidence.keep_best(evidence.keep_best(spark.createDataFrame(rows, PAPERS), "pos").drop("first_pos"), "pos")
    assert again.count() == 3


def test_citations(spark):
    df = spark.createDataFrame([("See [1] and [99], [2, 3].", 3), ("", 2), (None, 0)], "a string, n int")
    rows = df.select(evidence.citation_check(F.coalesce("a", F.lit("")), F.col("n")).alias("c"), evidence.verified(F.col("a"), F.col("n")).alias("v")).collect()
    assert rows[0].c.asDict() == {"cited": [1, 2, 3], "uncited": [], "invalid": [99], "total": 3, "cited_count": 3}
    assert rows[0].v == "See [1] and , [2, 3]."
    assert evidence.compact_text("a [3] b [1, 3]", [1, 3]) == "a [2] b [1, 2]"


def test_evidence_keys(spark):
    e = spark.createDataFrame([(1, "f", " 10.1/A ", "x"), (2, "f", "10.1/a", "y"), (3, "g", "10.1/a", "y"), (4, "f", None, ""), (5, "f", "", None)], "pos int, facet string, doi string, title string")
    assert sorted(r.pos for r in evidence.accumulated(e, "facet", "pos").collect()) == [1, 3, 4, 5]


def test_minmax(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", 7.0), ("b", 7.0)], "q string, x double")
    rows = df.withColumn("y", retrieval.minmax(F.col("x"), by=["q"])).collect()
    assert [r.y for r in rows if r.q == "a"] == [0, 0.25, 0.5, 0.75, 1] and {r.y for r in rows if r.q == "b"} == {0.5}


def brute_bm25(docs, q):
    toks = {k: t.lower().split() for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in raw.items()}
    out = {}
    for k, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q.lower().split() if w in t)
        if any(w in t for w in q.lower().split()):
            out[k] = s
    return out


def test_bm25(spark):
    docs = {1: "machine learning of cells", 2: "neural networks learn and neural nets", 3: "the the the cells", 4: "of the of", 5: "cells of networks"}
    q = "neural networks of cells cells"
    d = spark.createDataFrame([*docs.items(), (6, None)], "id long, t string")
    got = {r.id: r.score for r in index.scored(d, "id", "t", spark.createDataFrame([(9, q)], "qid long, q string"), "qid", "q").collect()}
    assert got == pytest.approx(brute_bm25(docs | {6: ""}, q))


def test_vector_topk(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, qv array<float>")
    rows = retrieval.vector_topk(v, "id", "v", q, "qid", "qv", 3).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in rows] == [(7, 1, 1.0), (7, 3, 1.0), (7, 2, 0.5)]
    monkeypatch.setattr(retrieval, "HELD", 0)
    again = retrieval.vector_topk(v, "id", "v", q, "qid", "qv", 3).orderBy("rank").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    empty = v.where("id < 0")
    assert retrieval.vector_topk(empty, "id", "v", q, "qid", "qv", 3).count() == 0
    monkeypatch.undo()
    assert retrieval.vector_topk(empty, "id", "v", q, "qid", "qv", 3).count() == 0


def test_fusion_repeated_text(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "a"), (1, 2, 0.8, "b"), (1, 3, 0.7, "a"), (2, 1, 0.9, "b")], "q long, rank int, score double, t string")
    rows = retrieval.fusion(hits, None, "q", "t").orderBy("place").collect()
    sig = lambda s: 1 / (1 + math.exp(-(s - 0.8) * 30))
    assert [(r.t, r.wrrf) for r in rows] == [("b", pytest.approx(sig(0.8) / 62 + sig(0.9) / 61)), ("a", pytest.approx(sig(0.7) / 63))]
    merged = retrieval.with_neighbours(retrieval.fusion(hits, None, "q", "t"), None, "t").orderBy("place").collect()
    assert [r.merged for r in merged] == ["b\na", "b\na\n"]


def test_scope(spark):
    ranked = spark.createDataFrame([(1, "p1", 0.9, 1), (1, "p2", 0.8, 2)], "q long, p string, score double, place int")
    forced = spark.createDataFrame([(1, "p9", 1)], "q long, p string, ord int")
    assert [tuple(r) for r in retrieval.merged_scope(ranked, forced, "q", "p", 5).collect()] == [(1, "p9", 0.55, 1)]
    two = spark.createDataFrame([(1, "p2", 1), (1, "p9", 2)], "q long, p string, ord int")
    assert [r.p for r in retrieval.merged_scope(ranked, two, "q", "p", 5).orderBy("place").collect()] == ["p2", "p9"]


def test_source_cap(spark):
    h = spark.createDataFrame([(i, s) for i, s in enumerate("aaabbc", 1)], "r int, s string")
    assert [r.r for r in retrieval.source_cap(h, None, "s", [F.col("r")], 1, 2).orderBy("pick").collect()] == [1, 4]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.integers(2, 12), st.integers(0, 6))
def test_windows_lose_nothing(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "id long, t string")
    chunks = chunking.word_windows(df, "id", "t", size, overlap)
    full = chunking.joined(chunks, "id", overlap).collect()
    assert [r.id for r in full] == [1]
    seen = full[0].full_text.split()
    assert [w for i, w in enumerate(seen) if w not in seen[:i]] == text.split()


def test_sections(spark):
    t = "intro line\n1. Methods\nwe did\nIII. Results and Discussion:\nwe saw\n\nReferences\n[1] x\n"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id long, t string")
    got = [(r.section, r.content) for r in chunking.sections(df, "id", "t").orderBy("section_index").collect()]
    assert got == [("_full", "intro line"), ("1. Methods", "we did"), ("III. Results and Discussion:", "we saw")]


def test_sentences():
    long = "This is a sentence of more than forty characters."
    assert chunking.sentence_list(f"Short one. Tiny. {long} End.\n\nNew line.") == ["Short one. Tiny.", long, "End. New line."]


def test_spans():
    assert chunking.repaired_spans([(5, 3), (8, 20), (4, 6)], 10) == [(0, 3), (3, 5), (5, 6), (6, 8), (8, 10)]
    parts = chunking.sized_spans("a b c d e f", [(0, 4), (4, 11)], 1, 2)
    assert " ".join(parts).split() == list("abcdef") and all(len(p.split()) <= 2 for p in parts)


def test_semantic_and_paragraphs(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["p" * 30] * 5)), (2, None)], "id long, t string")
    got = [r.chunk.count("p" * 30) for r in chunking.paragraphs(df, "id", "t", 70, 1).orderBy("chunk_index").collect()]
    assert sum(got) >= 5 and max(got) <= 2
    words = chunking.semantic(spark.createDataFrame([(1, "One two three. " * 40)], "id long, t string"), "id", "t", 30, 5, 0.0).collect()
    assert all(len(r.chunk.split()) <= 36 for r in words)


def test_conversation(spark):
    m = spark.createDataFrame([("c", i, "user" if i % 2 else "assistant", "x" * 40) for i in range(6)] + [("c", 9, "system", "s"), ("d", 1, "user", None)], "conversation_id string, n int, role string, content string")
    t = {r.conversation_id: r.tokens for r in conversation.conversation_tokens(m, "conversation_id").collect()}
    assert t["d"] == 2 + 4 + 1
    kept = conversation.within_budget(m, "conversation_id", ["n"], 60).where("conversation_id = 'c'").collect()
    assert sorted(r.n for r in kept) == [3, 4, 5, 9]
    b = {r.conversation_id: r.block for r in conversation.block(m, "conversation_id", ["n"], 100, 3).collect()}
    assert b["d"] == "" and b["c"].startswith("Recent conversation:\nAssistant: ")
    assert conversation.LIMITS["gpt-4"] == 8192
    c = spark.range(1).select(conversation.cost(F.lit("gpt-4o"), F.lit(1000), F.lit(500)).alias("c")).first().c
    assert 0.01 < c < 0.02


def test_survey(spark):
    p = spark.createDataFrame([(1, 2024, 5, 3.0, 1), (2, 2010, 9, None, 2), (3, 2023, 1, 4.0, 3), (4, None, None, 0.5, 4)], "pid long, year int, citations int, relevance double, pos long")
    a = spark.createDataFrame([(1, "t"), (2, "t")], "pid long, theme string")
    got = [(r.pid, r.reason) for r in survey.recommended(p, a, 2024).orderBy("place").collect()]
    assert got == [(2, "Highly cited in theme: t"), (3, "Recent advance in the field"), (1, "Recent advance in the field"), (4, "Highly relevant to the topic")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    a = spark.createDataFrame([("1", "p", "x"), ("2", "p", "y")], "id string, paper_id string, text string")
    s.replace("k1", a)
    s.append("k2", a.where("id = '1'"))
    assert s.names() == ["k1", "k2"] and s.read("k1").count() == 2
    s.delete_ids("k1", spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in s.read("k1").collect()] == ["2"]
    assert s.drop("k1") and s.names() == ["k2"] and not s.exists("k1")
    old = spark.createDataFrame([("k", 1, "old"), ("j", 2, "old")], "name string, created int, v string")
    new = spark.createDataFrame([("k", 9, "new")], "name string, created int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["name"], ["created"]).select("name", "created", "v").collect())) == [("j", 2, "old"), ("k", 1, "new")]


def test_dealt(spark):
    from paperlake.operators.skew import dealt

    df = spark.createDataFrame([("hot", i) for i in range(30)] + [("one", 99), ("two", 100), ("two", 101), (None, 5), (None, 6)], "k string, no long")
    a, b = dealt(df, ["k"], "no", rows=4)
    got = sorted((r.x, r.y) for r in a.withColumnRenamed("no", "x").join(b.withColumnRenamed("no", "y"), ["k", "_slice"]).where("x < y").select("x", "y").collect())
    assert got == [(x, y) for x in range(30) for y in range(x + 1, 30)] + [(100, 101)]
    assert a.groupBy("k", "_slice").count().where("count > 15").count() == 0


def test_shared_folder(spark, monkeypatch):
    from paperlake import session

    path = session.shared_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = session.cut(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].startswith(path.replace("file://", "file:///").replace("file:////", "file:///"))
    monkeypatch.setattr(session, "shared_dir", lambda _: path + "-mine")
    df = session.cut(spark.range(3))
    session.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from paperlake import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
    fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
