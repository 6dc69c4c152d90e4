"""The five modes of answering as compositions of operators over one knowledge base.

chunks: id (long), paper_id, chunk_index, chunk, embedding, source. Questions:
qid (long), q. All modes take many questions and return qid, place, paper_id,
score, full_text, from which prompts are made; the model is called by
``answered``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.functions import ids, text
from paperlake.operators import chunking
from paperlake.operators import retrieval as R
from paperlake.session import cut


@dataclass(frozen=True)
class Settings:
    """Settings of a mode; unknown names are an error."""

    top_k: int = 10
    min_score: float = 0.0
    overlap: int = 20
    initial: int = 150
    papers: int = 5
    per_source: int = 1
    paper_chars: int = 12_000
    hybrid: bool = False


class Engine:
    def __init__(self, chunks: DataFrame, embedder: connectors.Embedder, model: connectors.Model, settings: Settings = Settings()):
        self.chunks, self.embedder, self.model, self.s = chunks, embedder, model, settings
        self.modes = {"basic": self.basic, "advanced": self.advanced, "profound": self.profound, "agentic": self.agentic, "survey": self.survey}

    def query(self, mode: str, questions: DataFrame) -> DataFrame:
        """Rows of a mode; an unknown mode is ``basic``."""
        return self.modes.get(mode, self.basic)(questions)

    def _hits(self, questions: DataFrame, k: int) -> DataFrame:
        q = cut(connectors.embedded(questions.select("qid", "q"), "q", self.embedder, "qv"))
        found = R.vector_topk(self.chunks, "id", "embedding", q, "qid", "qv", k)
        return found.join(self.chunks.select("id", "paper_id", "source", "chunk"), "id")

    def _two_pass(self, best: DataFrame) -> DataFrame:
        return R.two_pass(cut(best), "qid", "paper_id", self.chunks, self.s.overlap, self.s.papers)

    def basic(self, questions: DataFrame) -> DataFrame:
        """The closest papers by vectors, with their whole text."""
        best = R.paper_best(self._hits(questions, 2 * self.s.top_k), "qid", "paper_id", self.s.top_k, self.s.min_score)
        return self._two_pass(best.select("qid", "paper_id", "score", "place"))

    def advanced(self, questions: DataFrame) -> DataFrame:
        """Fusion of each question and its phrasings, one paper per source, with their whole text.

        ``questions`` may hold ``phrasings`` (array of strings); they are fused with the question itself.
        """
        extra = F.coalesce("phrasings", F.array().cast("array<string>")) if "phrasings" in questions.columns else F.array().cast("array<string>")
        asked = questions.select("qid", F.posexplode(F.array_distinct(F.concat(F.array("q"), extra))).alias("n", "q"))
        flat = asked.select(ids.packed(F.col("qid"), F.col("n")).alias("qid"), "q")
        hits = self._hits(flat, self.s.initial).withColumn("req", F.shiftright("qid", ids.LOW_BITS))
        fused = R.fusion(hits, "req", "qid", "chunk")
        of = hits.groupBy("req", "chunk").agg(F.min(F.struct("qid", "rank", "paper_id", "source")).alias("m"))
        named = fused.join(of, ["req", "chunk"]).select("req", "place", "wrrf", "m.paper_id", "m.source")
        picked = R.source_cap(named, "req", "source", [F.col("place")], self.s.per_source, self.s.papers)
        best = picked.groupBy("req", "paper_id").agg(F.min("pick").alias("place"), F.max("wrrf").alias("score"))
        return self._two_pass(best.withColumnRenamed("req", "qid"))

    def profound(self, questions: DataFrame) -> DataFrame:
        """Basic retrieval for the question and each of its parts, merged by the best score of a paper."""
        from paperlake.functions.questions import cleaned, subqueries

        clean = questions.select("qid", "q", cleaned(F.col("q")).alias("_c"))
        parts = clean.select("qid", F.posexplode(F.array_distinct(F.array_prepend(subqueries(F.col("_c")), F.col("q")))).alias("n", "q"))
        flat = parts.select(ids.packed(F.col("qid"), F.col("n")).alias("qid"), "q")
        hits = self._hits(flat, self.s.top_k).withColumn("qid", F.shiftright("qid", ids.LOW_BITS))
        best = hits.groupBy("qid", "paper_id").agg(F.max("score").alias("score"))
        return self._two_pass(R.ranked(best, "qid", "paper_id").withColumnRenamed("rank", "place"))

    def agentic(self, questions: DataFrame) -> DataFrame:
        """Hybrid scores over the closest chunks, those of one half or more, by paper."""
        hits = self._hits(questions, 2 * self.s.top_k).join(questions.select("qid", "q"), "qid")
        hits = cut(hits)
        b = R.candidate_bm25(hits, "qid", "id", "chunk", "q")
        mixed = R.hybrid(hits.join(b, ["qid", "id"]), "qid", "id", "score", "bm25").where("hybrid >= 0.5")
        best = mixed.groupBy("qid", "paper_id").agg(F.max("hybrid").alias("score"))
        return self._two_pass(R.ranked(best, "qid", "paper_id").withColumnRenamed("rank", "place"))

    def survey(self, questions: DataFrame) -> DataFrame:
        """As basic, over more papers and without the limit of five."""
        best = R.paper_best(self._hits(questions, 100), "qid", "paper_id", 50).select("qid", "paper_id", "score", "place")
        best = cut(best)
        some = self.chunks.join(best.select("paper_id").distinct(), "paper_id", "left_semi")
        return best.join(chunking.joined(some, "paper_id", self.s.overlap), "paper_id", "left")

    def prompts(self, questions: DataFrame, papers: DataFrame) -> DataFrame:
        """qid, prompt: the papers of each question as numbered blocks, then the question."""
        null = F.lit(None).cast("string")
        block = text.paper_block(F.col("place"), F.col("paper_id").cast("string"), null, null, null, F.col("score"), F.col("full_text"), self.s.paper_chars)
        blocks = papers.withColumn("b", block).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "b"))).alias("p"))
        joined = F.array_join(F.transform("p", lambda x: x["b"]), "\n\n---\n\n")
        return questions.join(blocks, "qid", "left").select(
            "qid", F.concat(F.coalesce(joined, F.lit("No relevant papers found.")), F.lit("\n\nQuestion: "), "q").alias("prompt")
        )

    def answered(self, mode: str, questions: DataFrame) -> DataFrame:
        """qid, answer (citations of papers that were not given removed), cited."""
        from paperlake.operators import evidence

        found = cut(self.query(mode, questions))
        n = found.groupBy("qid").agg(F.count("*").cast("int").alias("n"))
        said = connectors.completed(self.prompts(questions, found), "prompt", self.model).join(n, "qid", "left")
        count = F.coalesce("n", F.lit(0))
        clean = evidence.verified(F.coalesce("answer", F.lit("")), count)
        return said.select("qid", clean.alias("answer"), evidence.citation_check(F.col("answer"), count).alias("check"))


def built(papers: DataFrame, embedder: connectors.Embedder, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of searchable papers (paper_id, title, authors, year, doi, abstract, full_text, source), with vectors."""
    from paperlake.operators.store import searchable

    some = searchable(papers)
    meta = chunking.metadata_chunk(some)
    body = chunking.word_windows(some, "paper_id", "full_text", size, overlap).withColumn("chunk_index", F.col("chunk_index") + 1)
    chunks = meta.unionByName(body).join(some.select("paper_id", "source"), "paper_id")
    named = chunks.withColumn("id", F.abs(F.xxhash64("paper_id", "chunk_index")))
    return connectors.embedded(named, "chunk", embedder)
