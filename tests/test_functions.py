"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from paperlake.functions import ids, questions, text
from paperlake.plans import planner


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


COMPOSITE = [
    ("aspirin vs ibuprofen", "vs"), ("A versus B", "versus"), ("Compare two methods", "compare"), ("a comparison of models", "comparison"),
    ("pros and cons of PCR", "pros_cons"), ("advantages and disadvantages of it", "adv_disadv"), ("difference between X and Y", "difference_between"),
    ("differences between X and Y", "differences_between"), ("speed tradeoffs", "tradeoffs"), ("trade-off of size", "tradeoffs"),
    ("effect of light on growth", "effect_on"), ("heat and its effect on yield", "and_effect_on"), ("what is DNA", ""), ("", ""), (None, ""),
]


def test_composite(spark):
    assert values(spark, [q for q, _ in COMPOSITE], questions.composite_tag) == [t for _, t in COMPOSITE]


def test_merged_complexity(spark):
    rows = [("effect_on", "simple"), ("effect_on", "composite"), ("vs", None), ("", "composite"), ("", None)]
    df = spark.createDataFrame(rows, "t string, m string")
    got = [tuple(r[0]) for r in df.select(questions.merged_complexity(F.col("t"), F.col("m"))).collect()]
    assert got == [
        ("simple", "simple"), ("composite", "heuristic+llm"), ("composite", "heuristic:vs"), ("composite", "llm"), ("simple", "simple")
    ]


CLEAN = [
    ("Tell me about enzymes", "enzymes"), ("What is DNA?", "DNA?"), ("how do cells move", "cells move"), ("I want to learn about  soil", "soil"),
    ("Explain X", "X"), ("enzymes", "enzymes"), ("", ""), ("i'd like to know about ice", "ice"),
]


def test_cleaned(spark):
    assert values(spark, [q for q, _ in CLEAN], questions.cleaned) == [c for _, c in CLEAN]
    assert [planner.cleaned(q) for q, _ in CLEAN] == [c for _, c in CLEAN]


SPLIT = [
    ("aspirin vs. ibuprofen", ["aspirin", "ibuprofen"]), ("flavonoids and their antioxidant activity", ["flavonoids", "flavonoids antioxidant activity"]),
    ("soil", ["soil"]), ("cat and dog", ["cat and dog"]),
]


def test_subqueries(spark):
    assert values(spark, [q for q, _ in SPLIT], questions.subqueries) == [s for _, s in SPLIT]
    assert [planner.subqueries(q) for q, _ in SPLIT] == [s for _, s in SPLIT]


STEPS = [
    ("kb_search", None, "kb_search"), ("Document Retrieval", None, "kb_search"), ("pubmed-search", None, "literature_search"), ("respond", None, "answer"),
    ("odd", "rag", "kb_search"), ("odd", "web_search", "web_search"), ("odd", None, "literature_search"), (None, None, "literature_search"),
]


def test_step_type(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(STEPS)], "i int, r string, t string, w string")
    rows = df.select("w", questions.step_type(F.col("r"), F.col("t")).alias("g")).collect()
    assert all(r.w == r.g for r in rows)
    assert [planner.step_type(r, t) for r, t, _ in STEPS] == [w for *_, w in STEPS]


def test_doi(spark):
    raw = ["https://doi.org/10.1/A", "http://dx.doi.org/10.1/a", "doi:10.1/a", " 10.1/a. ", "", None]
    assert values(spark, raw, ids.doi) == ["10.1/a", "10.1/a", "10.1/a", "10.1/a", "", ""]
    assert values(spark, raw, ids.doi_key)[3] == "10.1/a."
    assert values(spark, ["{10.1/A}", "https://dx.doi.org/10.1/A", "{}", None], ids.doi_bibtex) == ["10.1/A", "10.1/A", None, None]


def test_scholar_and_arxiv(spark):
    raw = ["10.1234/x", "2101.12345v2", "hep-th/9901001", "DOI:10.1/x", "12345678", "abc"]
    assert values(spark, raw, ids.scholar_id) == ["DOI:10.1234/x", "ArXiv:2101.12345v2", "ArXiv:hep-th/9901001", "DOI:10.1/x", "12345678", "abc"]
    urls = ["https://arxiv.org/abs/2604.06788", "https://arxiv.org/pdf/2604.06788v1", "https://x.org/abs/1", None]
    assert values(spark, urls, ids.arxiv_of_url) == ["2604.06788", "2604.06788v1", None, None]
    assert values(spark, ["10.48550/arXiv.2101.12345", "arXiv:2101.1", "10.1/x"], ids.arxiv_of_doi) == ["2101.12345", "2101.1", None]
    assert values(spark, ["https://arxiv.org/abs/2101.1?x#y", "https://a.org"], ids.arxiv_pdf) == ["https://arxiv.org/pdf/2101.1", None]
    assert values(spark, ["10.1021/acs.1", "https://doi.org/10.1038/s41586-1", "10.5/x"], ids.publisher) == ["ACS", "Springer", None]


def test_kb_names(spark):
    assert values(spark, [" my kb! 2 ", "a__b", "!!"], ids.kb_display) == ["my_kb_2", "a_b", None]


def test_tokens(spark):
    assert values(spark, [None, "", "abcdefgh", "äöüß" * 4], text.token_estimate) == [0, 0, 2, 12]
    assert values(spark, ["A b-c DE f1"], text.alnum_tokens) == [["de", "f1"]]
    assert values(spark, ["What (is) the 2020 DNA, dna?"], text.key_terms) == [["dna", "dna"]]
    assert values(spark, ["a" * 10 + " " + "b" * 10], lambda x: text.truncated(x, 3)) == ["a" * 10 + "..."]


def test_quoted_and_dois(spark):
    q = 'see "A Long Title Here" and \'another long title\' or "short" 10.1234/AbC), doi 10.1234/abc'
    assert values(spark, [q], text.quoted) == [["A Long Title Here", "another long title"]]
    assert values(spark, [q], text.dois) == [["10.1234/abc"]]


def test_normalized(spark):
    assert values(spark, ["Café–Ñ ﬁ", "Plain", None], text.normalized) == ["cafe-n fi", "plain", None]


def test_title_match(spark):
    df = spark.createDataFrame(
        [("deep learning", "deep learning for cells", 1.0), ("a b", "", 0.0), ("cell growth rate", "growth of cell walls", 2 / 3), (None, "x", 0.0)],
        "a string, b string, w double",
    )
    for r in df.select("w", text.title_match(F.col("a"), F.col("b")).alias("g")).collect():
        assert r.g == pytest.approx(r.w)


def test_json(spark):
    raw = ['```json\n{"a": [1,2,],}\n```', 'text {"a": 1} more', "none", None]
    assert values(spark, raw, text.json_slice) == ['{"a": [1,2,],}', '{"a": 1}', None, None]
    assert values(spark, raw[:1], text.json_repaired) == ['{"a": [1,2]}']


def test_hybrid_weights(spark):
    got = values(spark, ["0.7, 0.3", "3,1", "x", None], questions.hybrid_weights)
    assert [(round(r.vector, 3), round(r.bm25, 3)) for r in got] == [(0.7, 0.3), (0.75, 0.25), (0.5, 0.5), (0.5, 0.5)]


def test_planner():
    S = planner.Step
    plan = [S("kb1", "kb_search"), S("kb2", "kb_search"), S("ans", "answer", depends_on=["kb1", "kb2"])]
    assert [s.id for s in planner.batch(plan, set())] == ["kb1", "kb2"]
    assert [s.id for s in planner.batch(plan, {"kb1", "kb2"})] == ["ans"]
    assert planner.progress(0, set(), set(), 0) == "answer"
    assert planner.progress(2, {"a"}, set(), 1) == "replan"
    assert planner.progress(2, {"a"}, {"a"}, 1) == "continue"
    assert planner.progress(2, set(), set(), 1, sufficient=True, confidence=0.9) == "answer"
    assert planner.progress(2, {"a"}, {"a"}, 1, sufficient=False, missing=2) == "replan"
    assert [s.type for s in planner.fallback("tell me about X vs Y1Z", "PAPERS_ONLY", composite=False)] == ["literature_search", "answer"]
    first = planner.kb_first([S("s", "literature_search"), S("a", "answer", depends_on=["s"])], "x", False)
    assert [s.id for s in first] == ["kb1", "s", "a"] and first[1].depends_on == ["kb1"]
    assert planner.condition_met(S("s", "answer", condition="if results found"), ["", "no results"]) is False


def test_ready(spark):
    steps = spark.createDataFrame([("p", "a", "kb_search", []), ("p", "b", "answer", ["a"]), ("q", "a", "kb_search", [])], "plan string, id string, type string, depends_on array<string>")
    done = spark.createDataFrame([("p", ["a"])], "plan string, ids array<string>")
    assert sorted(map(tuple, planner.ready(steps, done).collect())) == [("p", "b"), ("q", "a")]


def test_title_tokens_of_all_titles(spark, tmp_path):
    from paperlake.plans import registry

    rows = [(1, "Growth of Cells"), (2, "Café–Ñandú growth… of cells"), (3, "細胞"), (4, "")]
    spark.createDataFrame(rows, "paper_no long, title string").write.parquet(f"{tmp_path}/papers.parquet")
    got = {r.paper_no: r.tokens for r in registry.QUERIES["title_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: ["cells", "growth"], 2: ["cafe", "cells", "growth", "nandu"], 3: [], 4: []}
