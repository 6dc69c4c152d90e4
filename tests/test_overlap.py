"""The best texts by common terms, against all pairs; no row per pair of a question and a text."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import index, overlap
from paperlake.operators import retrieval as R
from paperlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, k", [("bm25_normalized", 10), ("relevance_reorder", 10), ("bm25_topk", 5), ("two_pass_fulltext", 3)])
def test_rows_ranked(spark, monkeypatch, name, k):
    """What is ranked is at most k rows per question and task."""
    seen, plain = [], R.ranked
    monkeypatch.setattr(R, "ranked", lambda scores, *a: seen.append(scores) or plain(scores, *a))
    registry.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/papers.parquet").where("paper_no % 100 = 0 AND title IS NOT NULL").count()
    assert seen and all(0 < s.count() <= k * n * s.rdd.getNumPartitions() for s in seen)
    assert all(s.groupBy("qid", F.spark_partition_id()).count().where(F.col("count") > k).count() == 0 for s in seen)


@pytest.mark.parametrize("held", [100, 3])
@pytest.mark.parametrize("words", [40, 4])
def test_scored_best(spark, monkeypatch, words, held):
    """Ties, words in more than half of the texts, copies, keys and texts of null, many blocks."""
    monkeypatch.setattr(overlap, "CELLS", 64)
    monkeypatch.setattr(overlap, "POOL", 20)
    monkeypatch.setattr(overlap, "HELD", held)
    rnd = random.Random(words)
    some = lambda n: " ".join(f"w{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(n))
    texts = [some(rnd.randrange(1, 12)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:40]), (900, None), (901, " "), (None, None)], "id long, t string").repartition(3)
    q = spark.createDataFrame([*((i, some(4)) for i in range(11)), (50, "none"), (51, None)], "qid long, q string")
    want = R.topk(index.scored(docs, "id", "t", q, "qid", "q"), "qid", "id", 5)
    got = R.topk(index.scored_best(docs, "id", "t", q, "qid", "q", 5), "qid", "id", 5)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 50
