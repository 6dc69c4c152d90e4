"""Titles for quotations: against all pairs, and without a row per pair."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as T
from paperlake.operators import overlap, scope


def _tables(spark, seed, questions, papers, words):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["cells", "of", "the", "a", "x1", "Bäume", "植物", *(f"word{rnd.randrange(words)}" for _ in range(9))])
    titles = [rnd.choice([" ", "-", ": "]).join(word() for _ in range(rnd.randrange(1, 9) if rnd.random() < 0.03 else rnd.randrange(5, 9))) for _ in range(papers)]
    said = []
    for _ in range(questions):
        t = rnd.choice(titles)
        said.append(rnd.choice([t, t[1:], t[:-2], f"{t} and more {word()}", f"on {t}", " ".join(word() for _ in range(6))]))
    q = [(i, f'see "{a}" or "{b}"') for i, (a, b) in enumerate(zip(said, said[::-1]))]
    p = [(f"p{i}", t, papers - i) for i, t in enumerate([*titles, None, "", "word3"])]
    return spark.createDataFrame(q, "qid long, q string"), spark.createDataFrame(p, "paper_id string, title string, ord int").repartition(3)


@pytest.mark.parametrize("held", [500, 20])
def test_titles(spark, monkeypatch, held):
    """Quotations cut inside words, longer than titles, of other scripts; several equal scores."""
    monkeypatch.setattr(overlap, "CELLS", 500)
    monkeypatch.setattr(overlap, "HELD", held)
    questions, papers = _tables(spark, 1, 60, 250, 30)
    asked = questions.select("qid", F.posexplode(T.quoted(F.col("q"))).alias("place", "_q")).withColumn("_a", T.normalized(F.col("_q")))
    titled = papers.where("title <> ''").withColumn("_b", T.normalized(F.col("title")))
    mark = lambda c: F.array_append(T.token_set(F.col(c)), F.concat(F.lit("#"), F.left(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit(8))))
    pairs = asked.crossJoin(titled).where(F.arrays_overlap(mark("_a"), mark("_b"))).withColumn("s", T.title_match(F.col("_a"), F.col("_b"))).where(F.col("s") >= scope.LEAST)
    best = pairs.groupBy("qid", "place").agg(F.max(F.struct("s", -F.col("ord"), "paper_id")).alias("m"))
    want = sorted((r.qid, r.place, r.m.paper_id, r.m.s) for r in best.collect())
    got = sorted(map(tuple, scope.by_title(questions, papers, "qid", "q").select("qid", "place", "paper_id", "score").collect()))
    assert got == want and len(got) > 60 and len({r[3] for r in got}) > 2


def _joined(node):
    """Rows that the joins of an executed plan gave."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _joined(node.executedPlan())
    elif "QueryStage" in name:
        yield from _joined(node.plan())
    else:
        rows = node.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            yield rows.get().value()
        for i in range(node.children().size()):
            yield from _joined(node.children().apply(i))


@pytest.mark.parametrize("name", ["scope_title", "scope_resolve"])
def test_no_row_per_pair(spark, name):
    """A word that all titles and questions have does not make a row of each pair."""
    words = lambda i: " ".join(f"word{i * k % 997}" for k in range(2, 8))
    papers = spark.createDataFrame([(i, f"cells growing {words(i)}", None, i) for i in range(900)], "paper_id long, title string, doi string, ord long")
    questions = spark.createDataFrame([(i, f'"cells growing {words(i)}"') for i in range(0, 900, 10)], "qid long, q string")
    df = (scope.by_title if name == "scope_title" else scope.resolved)(questions, papers, "qid", "q")
    assert len(df.collect()) == 90
    rows = list(_joined(df._jdf.queryExecution().executedPlan()))
    assert rows and max(rows) < 5000  # of 81,000 pairs


def test_no_row_per_pair_kept(spark, monkeypatch):
    """Nor do the joins whose results are written before the last plan."""
    rows, plain = [], scope.cut

    def cut(df):
        df.collect()
        rows.extend(_joined(df._jdf.queryExecution().executedPlan()))
        return plain(df)

    monkeypatch.setattr(scope, "cut", cut)
    words = lambda i: " ".join(f"word{i * k % 997}" for k in range(2, 8))
    papers = spark.createDataFrame([(i, f"cells growing {words(i)}", i) for i in range(900)], "paper_id long, title string, ord long")
    questions = spark.createDataFrame([(i, f'"cells growing {words(i)}"') for i in range(0, 900, 10)], "qid long, q string")
    assert scope.by_title(questions, papers, "qid", "q").count() == 90
    assert len(rows) > 3 and max(rows) < 5000


@pytest.mark.parametrize("name", ["scope_title", "scope_resolve"])
def test_full_score_by_joins(spark, monkeypatch, name):
    """Only quotations without a title of score 1 are compared with all titles; of those of score 1 the first in order counts."""
    asked, plain = [], overlap.best
    monkeypatch.setattr(overlap, "best", lambda texts, q, n, *a, **kw: asked.append(n) or plain(texts, q, n, *a, **kw))
    titles = ["Slow growth of cells", "cells: growth, slow", "Fast decay of tissue", "On fast decay of tissue in mice", "Warm rivers and their banks"]
    papers = spark.createDataFrame([(i, t, None, 9 - i) for i, t in enumerate(titles)], "paper_id long, title string, doi string, ord long")
    said = ["Slow growth of cells", "Fast decay of tissue", "Warm rivers and other banks", "Nothing like any other"]
    questions = spark.createDataFrame([(i, f'"{q}"') for i, q in enumerate(said)], "qid long, q string")
    if name == "scope_title":
        got = sorted((r.qid, r.paper_id, round(r.score, 3)) for r in scope.by_title(questions, papers, "qid", "q").collect())
        assert got == [(0, 1, 1.0), (1, 3, 1.0), (2, 4, 0.75)]
    else:
        got = sorted((r.qid, r.forced, r.moderate) for r in scope.resolved(questions, papers, "qid", "q").collect())
        assert got == [(0, [1], 0), (1, [3], 0), (2, [4], 1), (3, [], 0)]
    assert asked == [2]
