"""The keyword index as DataFrames: postings, document frequencies and corpus figures.

``postings`` and ``frequencies`` are made once and stored; queries join the
postings of their own terms only. Okapi weights use k1 = 1.5, b = 0.75; a
negative inverse document frequency becomes EPSILON times the mean over terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import space_tokens
from paperlake.operators import overlap
from paperlake.operators.retrieval import SCALE

K1, B, EPSILON = 1.5, 0.75, 0.25
Tokenizer = Callable[[Column], Column]


def _each(tokens: Column) -> Column:
    """One row per token. The outer form keeps the optimizer from computing the tokens once more for a filter."""
    return F.explode_outer(tokens)


def lengths(docs: DataFrame, key: str, text: str, tokens: Tokenizer = space_tokens) -> DataFrame:
    """key, dl: tokens of each document, 0 for null."""
    return docs.select(F.col(key), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("dl"))


def postings(docs: DataFrame, key: str, text: str, tokens: Tokenizer = space_tokens) -> DataFrame:
    """key, term, tf. Equal terms of a document are summed before the shuffle."""
    t = docs.select(F.col(key), _each(tokens(F.col(text))).alias("term")).where("term IS NOT NULL")
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus(lens: DataFrame) -> DataFrame:
    """One row: n documents, avgdl."""
    return lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(docs: DataFrame, key: str, text: str, tokens: Tokenizer = space_tokens) -> DataFrame:
    """term, df."""
    t = docs.select(_each(F.array_distinct(tokens(F.col(text)))).alias("term")).where("term IS NOT NULL")
    return t.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf in a corpus of ``n`` documents. The mean is a single row."""
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select(
        "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )


def weight(tf: Column, dl: Column, avgdl: float) -> Column:
    """The part of a term's score that depends on its document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def query_terms(queries: DataFrame, key: str, text: str, tokens: Tokenizer = space_tokens) -> DataFrame:
    """key, term, qtf: terms of each question and how often it names them."""
    return postings(queries, key, text, tokens).withColumnRenamed("tf", "qtf")


def scored(
    docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str, tokens: Tokenizer = space_tokens
) -> DataFrame:
    """qkey, key, score of every document that holds a term of a question.

    Document tokens are cut down to the questions' terms by a semi-join
    before they are counted or shuffled; the optimizer broadcasts the terms
    where their size allows it.
    """
    size = corpus(lengths(docs, key, text, tokens)).first()  # two numbers
    qterms = query_terms(queries, qkey, qtext, tokens)
    vocabulary = qterms.select("term").distinct()
    weights = idf(frequencies(docs, key, text, tokens), size.n)
    with_dl = docs.select(F.col(key), tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("dl"), _each(F.col("_t")).alias("term"))
    tf = with_dl.where("term IS NOT NULL").join(vocabulary, "term", "left_semi").groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
    both = tf.join(weights.join(vocabulary, "term", "left_semi"), "term").join(qterms, "term")
    return both.groupBy(qkey, key).agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"), size.avgdl or 1.0) * F.col("qtf")).alias("score"))


def scored_best(
    docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str, k: int, tokens: Tokenizer = space_tokens
) -> DataFrame:
    """The rows of ``scored`` that can be among the ``k`` best of a question; keys are long.

    Whatever is below ``k`` rows of its own task stays there (see ``overlap``),
    so no row per pair of a question and a document is shuffled.
    """
    size = corpus(lengths(docs, key, text, tokens)).first()  # two numbers
    weights = idf(frequencies(docs, key, text, tokens), size.n)
    asked = query_terms(queries, qkey, qtext, tokens).join(weights, "term")
    asked = asked.select(F.col(qkey).cast("long").alias("_q"), "term", (F.col("idf") * F.col("qtf")).alias("w"))
    texts = docs.select(F.col(key).cast("long").alias("_k"), tokens(F.col(text)).alias("_t"))
    avgdl = size.avgdl or 1.0

    def part(tf, dl):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    found = overlap.best(texts, asked, queries.count(), k, part, SCALE)
    return found.select(F.col("_q").alias(qkey), F.col("_k").alias(key), "score")


def saved(store, kb: str, docs: DataFrame, key: str, text: str, tokens: Tokenizer = space_tokens) -> None:
    """Write postings, document frequencies and lengths of a knowledge base to its store."""
    store.replace(kb, postings(docs, key, text, tokens), "postings")
    store.replace(kb, frequencies(docs, key, text, tokens), "frequencies")
    store.replace(kb, lengths(docs, key, text, tokens), "lengths")


def scored_stored(store, kb: str, key: str, queries: DataFrame, qkey: str, qtext: str, tokens: Tokenizer = space_tokens) -> DataFrame:
    """``scored`` from a stored index: only postings of the questions' terms are read on."""
    lens = store.read(kb, "lengths").drop("kb_name")
    size = corpus(lens).first()
    weights = idf(store.read(kb, "frequencies").drop("kb_name"), size.n)
    terms = query_terms(queries, qkey, qtext, tokens)
    hits = store.read(kb, "postings").drop("kb_name").join(terms, "term").join(weights, "term").join(lens, key)
    return hits.groupBy(qkey, key).agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"), size.avgdl or 1.0) * F.col("qtf")).alias("score"))
