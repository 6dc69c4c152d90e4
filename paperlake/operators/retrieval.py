"""Search over vectors and keywords: top-k, filters, hybrid scores, rank fusion, caps and two passes.

All operators take many questions at once. Ties are broken by the smaller key
on scores rounded to SCALE digits. Defined results: null vectors and vectors
of zeros have cosine 0; questions without hits have no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 6
#: Questions multiplied with a batch of vectors at a time.
BLOCK = 1024
#: Questions that are shipped to all tasks at once; more are joined block by block.
HELD = 20_000


def filters(
    year_min: int | None = None, year_max: int | None = None, authors: list[str] | None = None,
    journals: list[str] | None = None, sources: list[str] | None = None, has_full_text: bool | None = None,
) -> Column | None:
    """A predicate over paper columns that the scan can take; null when nothing is asked."""
    parts = []
    if year_min is not None:
        parts.append(F.col("year") >= year_min)
    if year_max is not None:
        parts.append(F.col("year") <= year_max)
    if authors:
        parts.append(F.arrays_overlap(F.col("authors"), F.array(*[F.lit(a) for a in authors])))
    if journals:
        parts.append(F.col("journal").isin(journals))
    if sources:
        parts.append(F.col("source").isin(sources))
    if has_full_text is not None:
        full = F.coalesce(F.length(F.trim("full_text")) > 0, F.lit(False))
        parts.append(full if has_full_text else ~full)
    return reduce(lambda a, b: a & b, parts) if parts else None


def distance_score(cosine: Column) -> Column:
    """1 / (1 + distance) of a cosine, between 1/3 and 1."""
    return 1 / (1 + F.greatest(F.lit(0.0), 1 - cosine))


def vector_topk(vectors: DataFrame, key: str, vec: str, queries: DataFrame, qkey: str, qvec: str, k: int) -> DataFrame:
    """qkey, key, score, rank: the ``k`` vectors closest to each question by cosine.

    Up to HELD questions are shipped as one matrix and multiplied with each
    Arrow batch, BLOCK at a time. More are packed into blocks of rows, as the
    vectors are, and each pair of blocks is one product; the questions then
    never come to the driver. Either way a batch passes on its own k best per
    question only, so the shuffle holds k rows per question and batch.
    """
    asked = queries.select(F.col(qkey).cast("long").alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).where(F.col(qvec).isNotNull())
    stored = vectors.select(F.col(key).cast("long").alias("_k"), F.col(vec).cast("array<double>").alias("_w"))
    n = asked.count()
    if n <= HELD:
        rows = asked.orderBy("_q").toPandas()
        best = _against(stored, rows["_q"].to_numpy(dtype="int64"), [np.asarray(v) for v in rows["_v"]], k)
    else:
        blocks = asked.groupBy(F.pmod(F.xxhash64("_q"), F.lit(-(-n // BLOCK))).alias("b")).agg(F.collect_list(F.struct("_q", "_v")).alias("qs"))
        best = _blockwise(_packed(stored), blocks, k)
    named = best.select(F.col("_q").alias(qkey), F.col("_k").alias(key), "score")
    w = Window.partitionBy(qkey).orderBy(F.col("score").desc(), key)
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(ids: np.ndarray, mat: np.ndarray, keys: np.ndarray, dense: np.ndarray, k: int) -> list[np.ndarray]:
    """Question, key and score of the k best of each question; a vector of zeros has cosine 0."""
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    score = np.round(1 / (1 + np.maximum(0.0, 1 - unit(dense) @ unit(mat).T)), SCALE)
    tops = [np.lexsort((keys, -score[:, j]))[:k] for j in range(len(ids))]
    return [
        np.concatenate([np.full(len(t), q) for q, t in zip(ids, tops)]),
        np.concatenate([keys[t] for t in tops]),
        np.concatenate([score[t, j] for j, t in enumerate(tops)]),
    ]


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; nulls as zeros."""
    out = np.zeros((len(column), dim))
    ok = np.array([v.is_valid for v in column]) if column.null_count else np.ones(len(column), bool)
    if ok.any():
        out[ok] = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["_q", "_k", "score"])


def _against(stored: DataFrame, ids: np.ndarray, rows: list[np.ndarray], k: int) -> DataFrame:
    mat = np.array(rows, dtype="float64") if rows else np.zeros((0, 1))

    def run(batches):
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            keys, dense = b.column(0).to_numpy(zero_copy_only=False), _dense(b.column(1), mat.shape[1])
            yield _batch([_best(ids[i : i + BLOCK], mat[i : i + BLOCK], keys, dense, k) for i in range(0, len(ids), BLOCK)])

    return stored.mapInArrow(run, "_q long, _k long, score double")


def _packed(stored: DataFrame) -> DataFrame:
    """One row (ks, ws) per Arrow batch of vectors; null vectors as empty lists."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ws = [x if x is not None else [] for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([ws], pa.list_(pa.list_(pa.float64())))], ["ks", "ws"])

    return stored.mapInArrow(run, "ks array<long>, ws array<array<double>>")


def _blockwise(packed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each pair of a block of vectors and a block of the stated questions."""

    def run(batches):
        for b in batches:
            for ks, ws, qs in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, mat = np.array([q["_q"] for q in qs]), np.array([q["_v"] for q in qs], dtype="float64")
                dense = np.array([w or [0.0] * mat.shape[1] for w in ws], dtype="float64")
                yield _batch([_best(ids, mat, np.array(ks), dense, k)])

    return packed.crossJoin(blocks.select("qs")).mapInArrow(run, "_q long, _k long, score double")


def ranked(scores: DataFrame, qkey: str, key: str, score: str = "score") -> DataFrame:
    """``scores`` with ``rank`` from 1 within each question."""
    w = Window.partitionBy(qkey).orderBy(F.round(score, SCALE).desc(), key)
    return scores.withColumn("rank", F.row_number().over(w))


def topk(scores: DataFrame, qkey: str, key: str, k: int, score: str = "score") -> DataFrame:
    return ranked(scores, qkey, key, score).where(F.col("rank") <= k)


def minmax(x: Column, by: list[str] | None = None) -> Column:
    """Scores spread to 0..1 within a question; all equal gives 0.5."""
    w = Window.partitionBy(*(by or []))
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise((x - low) / (high - low))


def bm25_normalized(scores: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """The ``k`` best of each question divided by its best score, positive ones only, which are cut out after the top-k."""
    top = topk(scores, qkey, key, k)
    best = F.max("score").over(Window.partitionBy(qkey))  # of at most ``k`` rows, the best of all among them
    return top.withColumn("best", best).where(F.col("score") > 0).select(qkey, key, (F.col("score") / F.col("best")).alias("score"), "rank")


def candidate_bm25(cands: DataFrame, qkey: str, key: str, text: str, qtext: str) -> DataFrame:
    """qkey, key, bm25 of each candidate, with corpus figures of that question's candidates only."""
    from paperlake.functions.text import space_tokens
    from paperlake.operators.index import B, EPSILON, K1

    c = cands.select(qkey, key, space_tokens(F.col(text)).alias("t"), space_tokens(F.col(qtext)).alias("qt"))
    w = Window.partitionBy(qkey)
    c = c.withColumn("dl", F.coalesce(F.size("t"), F.lit(0))).withColumn("n", F.count("*").over(w)).withColumn("avgdl", F.avg("dl").over(w))
    df = c.select(qkey, "n", F.explode(F.array_distinct("t")).alias("term")).groupBy(qkey, "n", "term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = raw.withColumn("mean", F.avg("raw").over(Window.partitionBy(qkey)))
    weight = raw.select(qkey, "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms = c.select(qkey, key, "dl", "avgdl", "t", F.explode("qt").alias("term"))
    tf = F.size(F.filter("t", lambda x: x == F.col("term")))
    hits = terms.withColumn("tf", tf).where("tf > 0").join(weight, [qkey, "term"])
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = hits.groupBy(qkey, key).agg(F.sum(F.col("idf") * part).alias("bm25"))
    return c.select(qkey, key).join(found, [qkey, key], "left").select(qkey, key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def hybrid(cands: DataFrame, qkey: str, key: str, vector: str, bm25: str, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """``cands`` with ``hybrid``: the weighted sum of both scores, each spread to 0..1 within its question, and ``rank``."""
    mixed = weights[0] * minmax(F.col(vector), by=[qkey]) + weights[1] * minmax(F.col(bm25), by=[qkey])
    return ranked(cands.withColumn("hybrid", mixed), qkey, key, "hybrid")


def fusion(hits: DataFrame, group: str | None, qkey: str, text: str, k: int = 60, middle: float = 0.8, steep: float = 30.0) -> DataFrame:
    """Weighted reciprocal rank fusion: one row per text with ``wrrf`` and ``place`` from 1.

    hits: group (the request, may be null for one), qkey, rank, score, text.
    Equal texts are one entry; within a question the last of them counts.
    Ties keep the order of first sight (question, then rank).
    """
    by = [group] if group else []
    last = hits.groupBy(*by, qkey, F.col(text).alias("_t")).agg(
        F.max("rank").alias("rank"), F.max_by("score", "rank").alias("score"), F.min("rank").alias("seen")
    )
    part = 1 / (1 + F.exp(-(F.col("score") - middle) * steep)) / (k + F.col("rank"))
    total = last.groupBy(*by, "_t").agg(F.sum(part).alias("wrrf"), F.min(F.struct(qkey, "seen")).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.round("wrrf", 12).desc(), "first")
    return total.select(*by, F.col("_t").alias(text), "wrrf", "first", F.row_number().over(w).alias("place"))


def with_neighbours(placed: DataFrame, group: str | None, text: str, place: str = "place") -> DataFrame:
    """``placed`` with ``merged``: the texts before, of and after each entry in the ranking."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(place)
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    line = F.lit("\n")
    return placed.withColumn(
        "merged", F.concat(F.coalesce(F.concat(before, line), F.lit("")), F.col(text), line, F.coalesce(after, F.lit("")))
    )


def source_cap(hits: DataFrame, group: str | None, source: str, order: list[Column], per_source: int, total: int) -> DataFrame:
    """The first ``total`` rows in order of which no source has more than ``per_source``; adds ``pick`` from 1."""
    by = [group] if group else []
    inner = Window.partitionBy(*by, source).orderBy(*order)
    outer = Window.partitionBy(*by).orderBy(*order)
    kept = hits.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= per_source).drop("_n")
    return kept.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= total)


def paper_best(hits: DataFrame, qkey: str, paper: str, k: int, least: float = 0.0) -> DataFrame:
    """The best chunk of each paper among the first ``2 k`` hits with a score of ``least`` or more; ``place`` from 1 to k."""
    some = hits.where((F.col("rank") <= 2 * k) & (F.col("score") >= least))
    w = Window.partitionBy(qkey, paper).orderBy("rank")
    one = some.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    v = Window.partitionBy(qkey).orderBy("rank")
    return one.withColumn("place", F.row_number().over(v)).where(F.col("place") <= k)


def two_pass(best: DataFrame, qkey: str, paper: str, chunks: DataFrame, overlap: int, cap: int = 5) -> DataFrame:
    """qkey, place, paper, score, full_text: all chunks of the papers found, put together without overlaps.

    Chunks are cut to the papers wanted by a semi-join before they are sorted.
    """
    from paperlake.operators.chunking import joined

    wanted = best.where(F.col("place") <= min(cap, 5)).select(qkey, "place", paper, "score")
    some = chunks.join(wanted.select(paper).distinct(), paper, "left_semi")
    return wanted.join(joined(some, paper, overlap), paper, "left")


def zipped(df: DataFrame, *arrays: str) -> DataFrame:
    """One row per place (``pos``) of parallel arrays, as a vector store gives ids, texts and scores; short arrays give nulls."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z")).select(*rest, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def merged_scope(ranked_: DataFrame, forced: DataFrame, qkey: str, paper: str, cap: int) -> DataFrame:
    """qkey, paper, score, place: forced papers in their order, then the ranked ones, without repeats, ``cap`` at most.

    ranked_: qkey, paper, score, place. forced: qkey, paper, ord. A single
    forced paper stands alone, several raise the limit to their number at
    most; a forced paper without a score gets 0.55.
    """
    f = forced.select(qkey, paper, F.lit(0).alias("tier"), F.col("ord").alias("o"), F.lit(None).cast("double").alias("score"))
    r = ranked_.select(qkey, paper, F.lit(1).alias("tier"), F.col("place").alias("o"), "score")
    both = f.unionByName(r).groupBy(qkey, paper).agg(
        F.min(F.struct("tier", "o")).alias("_p"), F.coalesce(F.max("score"), F.lit(0.55)).alias("score")
    )
    n = forced.groupBy(qkey).agg(F.countDistinct(paper).alias("nf"))
    limit = F.when(F.col("nf") == 1, 1).when(F.col("nf") > 1, F.least(F.lit(cap), F.col("nf"))).otherwise(cap)
    w = Window.partitionBy(qkey).orderBy("_p.tier", "_p.o", paper)
    placed = both.join(n, qkey, "left").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return placed.select(qkey, paper, "score", "place")


def count_of(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0.0)


def reordered(hits: DataFrame, qkey: str, terms: str, text: str, title: str, year: str, as_of_year: int, place: str = "place") -> DataFrame:
    """``hits`` with ``relevance`` and ``new_place``: term counts, position, title match and recency.

    ``terms``: the question's key terms (array of strings).
    """
    low, ttl = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    freq = F.aggregate(terms, F.lit(0.0), lambda a, t: a + count_of(low, t))
    in_title = F.aggregate(terms, F.lit(0.0), lambda a, t: a + count_of(ttl, t))
    age = F.greatest(F.lit(0), F.lit(as_of_year) - F.col(year))
    boost = 1 + F.when(in_title > 0, 0.5).otherwise(0.0) + F.coalesce(0.5 * F.greatest(F.lit(0.0), 1 - age / F.lit(10.0)), F.lit(0.0))
    score = 0.6 * freq + 0.2 / F.col(place) + 0.2 * boost
    w = Window.partitionBy(qkey).orderBy(F.round("relevance", SCALE).desc(), place)
    return hits.withColumn("relevance", score).withColumn("new_place", F.row_number().over(w))
