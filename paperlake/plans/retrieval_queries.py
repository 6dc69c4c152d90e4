"""Queries and SQL of the keyword index and of retrieval.

Question vectors are the rows whose id is divisible by 100; question texts are
the titles of such papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text
from paperlake.operators import chunking, index
from paperlake.operators import retrieval as R
from paperlake.plans.text_queries import _CHUNKS, words_sql
from paperlake.session import cut, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings")


def _questions(s, d) -> DataFrame:
    return table(s, d, "papers").where("paper_no % 100 = 0 AND title IS NOT NULL").select(F.col("paper_no").alias("qid"), F.col("title").alias("q"))


def _vector_questions(s, d) -> DataFrame:
    return _vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _top(s, d, k: int, vectors: DataFrame | None = None) -> DataFrame:
    v = _vectors(s, d) if vectors is None else vectors
    return R.vector_topk(v, "vec_id", "embedding", _vector_questions(s, d), "qid", "qv", k)


_COS = """v AS (SELECT q.vec_id AS qid, e.vec_id, e.label, round(1 / (1 + greatest(0.0,
 1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]))), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0{}),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM v)"""


@query("vector_topk", f"WITH {_COS.format('')} SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_topk(s, d):
    return _top(s, d, 10)


@query("vector_topk_filtered", f"WITH {_COS.format(' AND e.label IN (1, 3)')} SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_topk_filtered(s, d):
    return _top(s, d, 10, _vectors(s, d).where(F.col("label").isin(1, 3)))


@query(
    "paper_filter",
    """SELECT paper_no FROM papers WHERE "year" >= 2015 AND "year" <= 2022 AND source IN ('scilex', 'bibtex') AND coalesce(length(trim(full_text)) > 0, false)""",
)
def paper_filter(s, d):
    return table(s, d, "papers").where(R.filters(2015, 2022, sources=["scilex", "bibtex"], has_full_text=True)).select("paper_no")


_BM = f"""t AS (SELECT doc_id, {words_sql("lower(coalesce(text, ''))")} AS w FROM documents),
 l AS (SELECT doc_id, len(w) dl FROM t), f AS (SELECT count(*) n, avg(dl) avgdl FROM l),
 x AS (SELECT doc_id, unnest(w) term FROM t), p AS (SELECT doc_id, term, count(*) tf FROM x GROUP BY ALL),
 df AS (SELECT term, count(*) df FROM p GROUP BY term),
 raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) raw FROM df, f),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END idf FROM raw)"""
_BMQ = f"""{_BM}, q AS (SELECT qid, term, count(*) qtf FROM (SELECT paper_no qid, unnest({words_sql('lower(title)')}) term FROM papers
 WHERE paper_no % 100 = 0 AND title IS NOT NULL) GROUP BY ALL),
 s AS (SELECT qid, doc_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) * qtf) score
 FROM p JOIN q USING (term) JOIN idf USING (term) JOIN l USING (doc_id), f GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) rank, max(score) OVER (PARTITION BY qid) best FROM s)"""


@query("bm25_postings", f"WITH {_BM} SELECT doc_id, term, tf FROM p")
def bm25_postings(s, d):
    return index.postings(spread(table(s, d, "documents"), "doc_id"), "doc_id", "text")


@query("bm25_idf", f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(s, d):
    docs = spread(table(s, d, "documents"), "doc_id")
    return index.idf(index.frequencies(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _scores(s, d, k: int) -> DataFrame:
    """Scores of the ``k`` best documents of each question, and some more."""
    return index.scored_best(spread(table(s, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", _questions(s, d), "qid", "q", k)


@query("bm25_topk", f"WITH {_BMQ} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(s, d):
    return R.topk(_scores(s, d, 5), "qid", "doc_id", 5).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_normalized", f"WITH {_BMQ} SELECT qid, doc_id, round(score / best, 6) AS score, rank FROM r WHERE rank <= 10 AND score > 0")
def bm25_normalized(s, d):
    return R.bm25_normalized(_scores(s, d, 10), "qid", "doc_id", 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "minmax_normalize",
    """SELECT paper_no, round(CASE WHEN max(citation_count) OVER w = min(citation_count) OVER w THEN 0.5
 ELSE (citation_count - min(citation_count) OVER w) / (max(citation_count) OVER w - min(citation_count) OVER w)::double END, 6) AS spread
 FROM papers WHERE citation_count IS NOT NULL WINDOW w AS (PARTITION BY "year")""",
)
def minmax_normalize(s, d):
    p = table(s, d, "papers").where("citation_count IS NOT NULL")
    return p.select("paper_no", F.round(R.minmax(F.col("citation_count"), by=["year"]), 6).alias("spread"))


# Candidates of a question: the texts of the documents whose ids are those of its closest vectors.
_CAND = f"""{_COS.format('')}, c AS (SELECT r.qid, r.vec_id, r.score, d.text, d.source, d.doc_id, p.title q FROM r JOIN documents d ON d.doc_id = r.vec_id
 JOIN papers p ON p.paper_no = r.qid WHERE r.rank <= 50)"""


def _candidates(s, d) -> DataFrame:
    hits = _top(s, d, 50)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "paper_id")
    return hits.join(docs, "vec_id").join(table(s, d, "papers").select(F.col("paper_no").alias("qid"), F.col("title").alias("q")), "qid")


_CBM = f"""{_CAND}, ct AS (SELECT qid, vec_id, score, {words_sql("lower(coalesce(text, ''))")} w, {words_sql("lower(coalesce(q, ''))")} qw FROM c),
 cl AS (SELECT *, len(w) dl, count(*) OVER (PARTITION BY qid) n, avg(len(w)) OVER (PARTITION BY qid) avgdl FROM ct),
 cdf AS (SELECT qid, n, term, count(*) df FROM (SELECT qid, n, unnest(list_distinct(w)) term FROM cl) GROUP BY ALL),
 craw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) raw FROM cdf), cm AS (SELECT *, avg(raw) OVER (PARTITION BY qid) mean FROM craw),
 cidf AS (SELECT qid, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END idf FROM cm),
 cx AS (SELECT qid, vec_id, dl, avgdl, w, unnest(qw) term FROM cl),
 ctf AS (SELECT qid, vec_id, dl, avgdl, term, len(list_filter(w, lambda x: x = term)) tf FROM cx),
 cs AS (SELECT qid, vec_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) bm25 FROM ctf JOIN cidf USING (qid, term) WHERE tf > 0 GROUP BY ALL),
 cb AS (SELECT qid, vec_id, score, coalesce(bm25, 0) bm25 FROM ct LEFT JOIN cs USING (qid, vec_id)),
 cn AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END nv,
  CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0.5 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END nb
  FROM cb WINDOW w AS (PARTITION BY qid)), ch AS (SELECT qid, vec_id, 0.5 * nv + 0.5 * nb hybrid FROM cn)"""


@query(
    "hybrid_rank",
    f"""WITH {_CBM} SELECT qid, vec_id, round(hybrid, 6) AS hybrid, row_number() OVER (PARTITION BY qid ORDER BY round(hybrid, 6) DESC, vec_id) AS rank FROM ch""",
)
def hybrid_rank(s, d):
    c = _candidates(s, d)
    b = R.candidate_bm25(c, "qid", "vec_id", "text", "q")
    both = c.select("qid", "vec_id", "score").join(b, ["qid", "vec_id"])
    return R.hybrid(both, "qid", "vec_id", "score", "bm25").select("qid", "vec_id", F.round("hybrid", 6).alias("hybrid"), "rank")


# A request is a group of three questions (qid modulo 3); its hits are fused.
_FUSE = f"""{_COS.format('')}, h AS (SELECT r.qid % 300 // 100 AS req, r.qid, r.rank, r.score, coalesce(d.text, '') AS text, d.source FROM r JOIN documents d ON d.doc_id = r.vec_id
 WHERE r.rank <= 150),
 lastr AS (SELECT req, qid, text, max(rank) rank, arg_max(score, rank) score, min(rank) seen FROM h GROUP BY ALL),
 tot AS (SELECT req, text, sum(1 / (1 + exp(-(score - 0.8) * 30.0)) / (60 + rank)) wrrf, min((qid, seen)) f FROM lastr GROUP BY ALL),
 pl AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY round(wrrf, 12) DESC, f) place FROM tot)"""


def _fused(s, d) -> DataFrame:
    hits = _top(s, d, 150).join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text")), "vec_id")
    return R.fusion(hits.withColumn("req", F.floor(F.col("qid") % 300 / 100)), "req", "qid", "text")


@query("wrrf_fusion", f"WITH {_FUSE} SELECT req, md5(text) AS text_md5, round(wrrf, 9) AS wrrf, place FROM pl")
def wrrf_fusion(s, d):
    return _fused(s, d).select("req", F.md5("text").alias("text_md5"), F.round("wrrf", 9).alias("wrrf"), "place")


@query(
    "wrrf_neighbour_merge",
    f"""WITH {_FUSE}, m AS (SELECT *, coalesce(lag(text) OVER w || chr(10), '') || text || chr(10) || coalesce(lead(text) OVER w, '') AS merged
 FROM pl WINDOW w AS (PARTITION BY req ORDER BY place)) SELECT req, place, md5(merged) AS merged_md5, length(merged) AS n FROM m WHERE place <= 10""",
)
def wrrf_neighbour_merge(s, d):
    m = R.with_neighbours(_fused(s, d), "req", "text").where("place <= 10")
    return m.select("req", "place", F.md5("merged").alias("merged_md5"), F.length("merged").cast("long").alias("n"))


@query(
    "source_cap",
    """WITH c AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) n, n_chars FROM documents
 WHERE text IS NOT NULL AND source IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) pick FROM c WHERE n <= 2)
 SELECT doc_id, lang, source, pick FROM k WHERE pick <= 5""",
)
def source_cap(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return R.source_cap(docs, "lang", "source", [F.col("n_chars").desc(), F.col("doc_id")], 2, 5).select("doc_id", "lang", "source", "pick")


_PAPERS = f"""{_COS.format('')}, h AS (SELECT r.qid, r.vec_id, r.score, r.rank, d.paper_id FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 20),
 pb AS (SELECT *, row_number() OVER (PARTITION BY qid, paper_id ORDER BY rank) n FROM h),
 pp AS (SELECT qid, paper_id, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) place FROM pb WHERE n = 1)"""


def _papers_found(s, d) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "paper_id")
    return R.paper_best(_top(s, d, 20).join(docs, "vec_id"), "qid", "paper_id", 10)


@query("paper_dedup_search", f"WITH {_PAPERS} SELECT qid, paper_id, vec_id, score, place FROM pp WHERE place <= 10")
def paper_dedup_search(s, d):
    return _papers_found(s, d).select("qid", "paper_id", "vec_id", "score", "place")


@query(
    "two_pass_fulltext",
    f"""WITH {_BMQ}, w AS (SELECT qid, place, doc_id, score FROM (SELECT qid, doc_id, score, rank place FROM r) WHERE place <= 3),
 {_CHUNKS}, pc AS (SELECT doc_id, chunk_index, chunk, string_split(chunk, ' ') AS cw,
 lag(string_split(chunk, ' ')) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pw FROM c),
 tc AS (SELECT *, pw[greatest(1, len(pw) - 19):] AS tail FROM pc),
 mc AS (SELECT *, list_filter(range(least(len(tail), len(cw)), 0, -1), lambda m: tail[1:m] = cw[1:m]) AS hits FROM tc),
 jc AS (SELECT doc_id, string_agg(CASE WHEN len(hits) > 0 THEN array_to_string(cw[hits[1] + 1:], ' ') ELSE chunk END, ' ' ORDER BY chunk_index) full_text
 FROM mc GROUP BY doc_id) SELECT qid, place, doc_id, round(score, 6) AS score, md5(full_text) AS text_md5 FROM w LEFT JOIN jc USING (doc_id)""",
)
def two_pass_fulltext(s, d):
    docs = spread(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    best = cut(R.topk(_scores(s, d, 3), "qid", "doc_id", 3).withColumnRenamed("rank", "place"))
    wanted = docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = chunking.word_windows(wanted, "doc_id", "text", 100, 20)
    out = R.two_pass(best, "qid", "doc_id", chunks, 20)
    return out.select("qid", "place", "doc_id", F.round("score", 6).alias("score"), F.md5("full_text").alias("text_md5"))


@query(
    "relevance_reorder",
    f"""WITH {_BMQ}, k AS (SELECT paper_no qid, list_filter(list_transform({words_sql('lower(title)')}, lambda t: trim(t, '.,?!:;()[]{{}}"''')),
 lambda t: t NOT IN ({', '.join(repr(w) for w in text.KEY_STOPWORDS)}) AND length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')) terms
 FROM papers WHERE paper_no % 100 = 0 AND title IS NOT NULL),
 h AS (SELECT r.qid, r.doc_id, r.rank place, lower(coalesce(d.text, '')) x, lower(coalesce(d.section, '')) y, "year"(d.loaded_at) yr, terms
 FROM r JOIN documents d USING (doc_id) JOIN k USING (qid) WHERE rank <= 10),
 z AS (SELECT *, coalesce(list_sum(list_transform(terms, lambda t: (length(x) - length(replace(x, t, ''))) / length(t)::double)), 0) fr,
 coalesce(list_sum(list_transform(terms, lambda t: (length(y) - length(replace(y, t, ''))) / length(t)::double)), 0) ti FROM h),
 o AS (SELECT qid, doc_id, place, 0.6 * fr + 0.2 / place + 0.2 * (1 + CASE WHEN ti > 0 THEN 0.5 ELSE 0 END
 + coalesce(0.5 * greatest(0.0, 1 - greatest(0, 2026 - yr) / 10.0), 0)) relevance FROM z)
 SELECT qid, doc_id, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 6) DESC, place) AS new_place FROM o""",
)
def relevance_reorder(s, d):
    hits = R.topk(_scores(s, d, 10), "qid", "doc_id", 10).withColumnRenamed("rank", "place")
    docs = table(s, d, "documents").select("doc_id", "text", "section", F.year("loaded_at").alias("yr"))
    q = _questions(s, d).select("qid", text.key_terms(F.col("q")).alias("terms"))
    out = R.reordered(hits.join(docs, "doc_id").join(q, "qid"), "qid", "terms", "text", "section", "yr", 2026)
    return out.select("qid", "doc_id", F.round("relevance", 6).alias("relevance"), "new_place")

