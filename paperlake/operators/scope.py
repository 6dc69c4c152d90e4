"""Which papers a question names: by DOI, or by a title in quotation marks.

Title candidates share a word, or their first eight letters for titles without
one; the arg-max of the match score is taken per quotation. Pairs of a
question and a paper are not rows; see ``overlap``. Quotations with a title of
the highest score, 1, are found by joins alone and compared with no other.

Defined results: a paper without title and DOI is never named; of equal scores
the smaller ``ord`` wins; a quotation that fits no title with 0.32 or more
names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import ids, text
from paperlake.operators import overlap
from paperlake.session import cut, spread

LEAST, SURE = 0.32, 0.85


def by_doi(questions: DataFrame, papers: DataFrame, qkey: str, q: str) -> DataFrame:
    """qkey, paper_id, place: the first paper in order of each DOI in a question. papers: paper_id, doi, ord."""
    asked = questions.select(qkey, F.posexplode(text.dois(F.col(q))).alias("place", "_d"))
    first = papers.where(F.coalesce("doi", F.lit("")) != "").groupBy(ids.doi(F.col("doi")).alias("_d")).agg(F.min_by("paper_id", "ord").alias("paper_id"))
    hit = asked.join(first.where("_d <> ''"), "_d")
    return hit.groupBy(qkey, "paper_id").agg(F.min("place").alias("place"))


def _marks(x: Column) -> Column:
    """Of normalized text: its words and, after ``#``, its first eight letters."""
    return F.array_append(text.token_set(x), F.concat(F.lit("#"), F.left(F.regexp_replace(x, "[^\\p{L}\\p{N}]", ""), F.lit(8))))


def _parts(x: Column) -> Column:
    """All runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), F.lit(1))


def _triples(runs: Column) -> Column:
    """Each three runs in a row as one string."""
    starts = F.when(F.size(runs) > 2, F.sequence(F.lit(1), F.size(runs) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(runs, i, F.lit(3)), " "))


def _inner_keys(x: Column) -> Column:
    """Keys of which any text that holds ``x`` and shares a mark with it has one in its ``_outer_keys``.

    All runs but the first and the last are whole runs of the holder too, so the
    longest three of them in a row are enough; a text of under five runs has its marks.
    """
    runs = _parts(x)
    inner = _triples(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0))))
    longest = F.array_max(F.transform(inner, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    return F.when(F.size(runs) > 4, F.array(longest)).otherwise(F.array_distinct(_marks(x)))


def _outer_keys(x: Column) -> Column:
    return F.array_distinct(F.concat(_triples(_parts(x)), _marks(x)))


def _same(said: DataFrame, titles: DataFrame, few: bool) -> DataFrame:
    """_q, _f (ord, paper_id): the first title in order of the very words of a quotation."""
    hint = F.broadcast if few else lambda df: df
    words = lambda x: F.array_join(F.array_sort(text.token_set(F.col(x))), " ")
    a = said.select("_q", words("_qn").alias("_w")).where("_w <> ''")
    b = titles.select(words("_tn").alias("_w"), F.struct("ord", "paper_id").alias("_f"))
    first = b.join(hint(a.select("_w").distinct()), "_w", "left_semi").groupBy("_w").agg(F.min("_f").alias("_f"))
    return a.join(first, "_w").select("_q", "_f")


def _holding(said: DataFrame, titles: DataFrame, few: bool) -> DataFrame:
    """_q, _f (ord, paper_id): the first title in order that a quotation holds or that holds it."""
    hint = F.broadcast if few else lambda df: df
    a, b = said.select("_q", "_qn"), titles.select("paper_id", "ord", "_tn")
    around = b.withColumn("_w", F.explode(_outer_keys(F.col("_tn")))).join(hint(a.withColumn("_w", F.explode(_inner_keys(F.col("_qn"))))), "_w").where(F.contains("_tn", "_qn"))
    within = b.withColumn("_w", F.explode(_inner_keys(F.col("_tn")))).join(hint(a.withColumn("_w", F.explode(_outer_keys(F.col("_qn"))))), "_w").where(F.contains("_qn", "_tn"))
    pairs = around.unionByName(within).where(F.arrays_overlap(_marks(F.col("_qn")), _marks(F.col("_tn"))))
    return pairs.groupBy("_q").agg(F.min(F.struct("ord", "paper_id")).alias("_f"))


def by_title(questions: DataFrame, papers: DataFrame, qkey: str, q: str) -> DataFrame:
    """qkey, place, paper_id, score: the best title for each quotation, of LEAST or more. papers: paper_id, title, ord.

    Equal quotations and equal titles count once. A score of 1 is found by
    joins: titles of the same words on these, titles inside quotations and the
    other way round on three words in a row. For the other quotations the
    scores of common words are summed block by block (``overlap``), each task
    passing on one title per quotation.
    """
    asked = questions.select(qkey, F.posexplode(text.quoted(F.col(q))).alias("place", "_q")).select(qkey, "place", text.normalized(F.col("_q")).alias("_qn"))
    said = cut(asked.where("_qn <> ''").select("_qn").distinct().withColumn("_q", F.monotonically_increasing_id()))
    n = said.count()
    titled = papers.where(F.coalesce("title", F.lit("")) != "").select(text.normalized(F.col("title")).alias("_tn"), F.struct("ord", "paper_id").alias("_f"))
    titles = cut(titled.where("_tn <> ''").groupBy("_tn").agg(F.min("_f").alias("_f")).select("_tn", "_f.*"))
    few = n <= overlap.HELD
    full = _same(said, titles, few).unionByName(_holding(said, titles, few)).groupBy("_q").agg(F.min("_f").alias("_f"))
    full = cut(full.select("_q", "_f.paper_id", "_f.ord", F.lit(1.0).alias("score")))
    rest = cut(said.join(full, "_q", "left_anti"))
    scored = full
    if m := rest.count():
        words = rest.withColumn("_s", text.token_set(F.col("_qn"))).select("_q", F.size("_s").alias("size"), F.explode("_s").alias("term"), F.lit(1.0).alias("w"))
        order = F.coalesce(F.col("ord").cast("long"), F.lit(-(2**63)))
        texts = spread(titles).select(order.alias("_k"), text.token_set(F.col("_tn")).alias("_t"), "paper_id", "ord")
        scored = full.unionByName(overlap.best(texts, words, m, 1, least=LEAST).select("_q", "paper_id", "ord", "score"))
    w = Window.partitionBy("_q").orderBy(F.col("score").desc(), "ord")
    first = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return asked.join(said, "_qn").join(first, "_q").select(qkey, "place", "paper_id", "score")


def resolved(questions: DataFrame, papers: DataFrame, qkey: str, q: str, cap: int = 5) -> DataFrame:
    """qkey, forced (paper ids in order, DOIs first), max_papers, moderate (number of matches below SURE) of every question."""
    d = by_doi(questions, papers, qkey, q).select(qkey, "paper_id", F.struct(F.lit(0).alias("t"), "place").alias("o"), F.lit(1.0).alias("score"))
    t = by_title(questions, papers, qkey, q).select(qkey, "paper_id", F.struct(F.lit(1).alias("t"), "place").alias("o"), "score")
    one = d.unionByName(t).groupBy(qkey, "paper_id").agg(F.min("o").alias("o"), F.max("score").alias("score"))
    forced = one.groupBy(qkey).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "paper_id"))), lambda x: x["paper_id"]).alias("forced"),
        F.count_if(F.col("score") < SURE).alias("moderate"),
    )
    n = F.size("forced")
    most = F.when(n == 1, 1).when(n > 1, F.least(F.lit(cap), n)).otherwise(cap)
    none = F.array().cast(papers.select(F.collect_list("paper_id").alias("x")).schema["x"].dataType)
    return (
        questions.select(qkey).join(forced, qkey, "left")
        .withColumn("forced", F.coalesce("forced", none))
        .select(qkey, "forced", most.alias("max_papers"), F.coalesce("moderate", F.lit(0)).alias("moderate"))
    )


def note(title: F.col, forced_count: F.col, moderate: F.col) -> F.col:
    """A sentence for the prompt about the papers named; null if none is."""
    one = F.concat(F.lit("The question is about this paper of the knowledge base: "), title, F.lit("."))
    hint = F.when(moderate > 0, " A quoted title was matched with moderate confidence; a DOI would be certain.").otherwise("")
    return F.when(forced_count == 1, F.concat(one, hint)).when(forced_count > 1, F.concat(F.lit("The question names several papers; each is to be addressed."), hint))
