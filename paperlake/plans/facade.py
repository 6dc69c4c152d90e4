"""The engine's tools under their usual names, over a store and connectors.

Each tool takes and returns plain values or DataFrames; results can be put in
an envelope by ``streaming.events.envelope``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.functions import ids
from paperlake.operators import retrieval, store
from paperlake.plans import engine
from paperlake.sources import bibtex, markup

VERSION = "0.1.0"


@dataclass
class Tools:
    spark: SparkSession
    store: store.Store
    embedder: connectors.Embedder
    model: connectors.Model
    content: connectors.Fetcher
    size: int = 1000
    overlap: int = 200

    def get_info(self) -> dict:
        return {"name": "paperlake", "version": VERSION, "tools": sorted(n for n in dir(self) if "_" in n and not n.startswith("_"))}

    def search_literature(self, records: DataFrame, words: str, most: int = 20) -> DataFrame:
        """Rows of a table of records that hold all words in title or abstract, the most cited first."""
        text = F.lower(F.concat_ws(" ", "title", "abstract"))
        hits = records.where(F.forall(F.array(*[F.lit(w) for w in words.lower().split()]), lambda w: F.contains(text, w)))
        return hits.orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "id").limit(most)

    def get_paper_content(self, dois: DataFrame) -> DataFrame:
        """doi, content of each distinct DOI, null where there is none."""
        return connectors.fetched(dois.select("doi"), "doi", self.content)

    def get_paper_references(self, dois: DataFrame) -> DataFrame:
        """References of the XML a connector brings for each DOI."""
        return markup.article_references(self.get_paper_content(dois), "doi", "content")

    def list_knowledge_bases(self) -> DataFrame:
        """kb_name, chunks, papers; no rows without a knowledge base."""
        if not self.store.names():
            return self.spark.createDataFrame([], "kb_name string, chunks long, papers long")
        return store.stats(self.store.read())

    def search_knowledge_base(self, kb: str, questions: DataFrame, k: int = 10) -> DataFrame:
        """qid, paper_id, score, place: the closest papers of one knowledge base."""
        q = connectors.embedded(questions.select("qid", "q"), "q", self.embedder, "qv")
        chunks = self.store.read(kb)
        hits = retrieval.vector_topk(chunks, "id", "embedding", q, "qid", "qv", 2 * k).join(chunks.select("id", "paper_id"), "id")
        return retrieval.paper_best(hits, "qid", "paper_id", k).select("qid", "paper_id", "score", "place")

    def create_knowledge_base(self, name: str, bib: str | None = None) -> int:
        """The number of papers of a new knowledge base, from a BibTeX file if one is given; an existing name is an error."""
        kb = self.spark.range(1).select(ids.kb_display(F.lit(name)).alias("n")).first().n
        if not kb:
            raise ValueError("the name has no usable character")
        if self.store.exists(kb):
            raise ValueError(f"{kb} exists")
        if bib is None:
            return 0
        papers = bibtex.papers(bibtex.normalized(bibtex.scan(self.spark, bib)))
        return self.add_papers_to_kb(kb, self._flat(papers))

    def _flat(self, papers: DataFrame) -> DataFrame:
        names = F.array_join(F.transform("authors", lambda a: a["name"]), ", ")
        return papers.select(F.col("id").alias("paper_id"), "title", names.alias("authors"), "year", "doi", "abstract", "full_text", "source")

    def add_papers_to_kb(self, kb: str, papers: DataFrame) -> int:
        """The number of papers added: those not there yet, the first row of each, that have text."""
        new = store.first_seen(papers, ["paper_id"])
        if self.store.exists(kb):
            new = store.without(new, self.store.read(kb).select("paper_id"), "paper_id")
        chunks = engine.built(new, self.embedder, self.size, self.overlap).persist()
        try:
            n = chunks.select("paper_id").distinct().count()
            if n:
                self.store.append(kb, chunks)
            return n
        finally:
            chunks.unpersist()

    def delete_knowledge_base(self, kb: str) -> bool:
        return self.store.drop(kb)

    def generate_report(self, kb: str, questions: DataFrame, mode: str = "profound") -> DataFrame:
        """qid, answer, check of each question in a mode."""
        return engine.Engine(self.store.read(kb), self.embedder, self.model).answered(mode, questions)
