"""Heuristics over questions and plan steps as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import strip

# Patterns of questions with several aspects, tried in this order.
COMPOSITE = [
    (r"\bvs\.?\b", "vs"),
    (r"\bversus\b", "versus"),
    (r"\bcompare\b", "compare"),
    (r"\bcomparison\b", "comparison"),
    (r"\bpros and cons\b", "pros_cons"),
    (r"\badvantages and disadvantages\b", "adv_disadv"),
    (r"\bdifference between\b", "difference_between"),
    (r"\bdifferences between\b", "differences_between"),
    (r"\btrade-?offs?\b", "tradeoffs"),
    (r"\beffect of .{3,80} on\b", "effect_on"),
    (r"\band its effect on\b", "and_effect_on"),
]
WEAK_TAGS = ["effect_on"]
# Openings without content, tried in this order.
OPENINGS = [
    "i want to learn about", "i want to know about", "tell me about", "what is", "what are", "how does", "how do", "explain",
    "describe", "can you tell me about", "i'd like to know about",
]
# Words that point to a kind of source.
COMPOUND_WORDS = ["lotus", "natural product", "compound", "metabolite", "structure", "chemical"]
COMPOUND_ONLY = ["lotus only", "only lotus", "search lotus"]
PAPER_WORDS = ["paper", "article", "research", "literature", "study", "publication"]
# Kinds of plan steps and other names for them.
STEP_TYPES = [
    "lotus_search", "literature_search", "download_papers", "kb_search", "web_search", "paper_lookup", "analyze", "synthesize", "answer",
]
STEP_ALIASES = {
    "document_retrieval": "kb_search", "document_retrieval_step": "kb_search", "doc_retrieval": "kb_search",
    "retrieve_documents": "kb_search", "vector_search": "kb_search", "rag_search": "kb_search", "kb_retrieval": "kb_search",
    "corpus_search": "kb_search", "knowledge_base_search": "kb_search", "paper_retrieval": "literature_search",
    "literature_retrieval": "literature_search", "academic_search": "literature_search", "scholar_search": "literature_search",
    "pubmed_search": "literature_search", "openalex_search": "literature_search", "final_answer": "answer", "respond": "answer",
    "semantic_scholar_lookup": "paper_lookup", "paper_search_by_id": "paper_lookup", "lookup_paper": "paper_lookup",
}
TOOL_ALIASES = {
    "document_retrieval": "kb_search", "doc_retrieval": "kb_search", "retrieve_documents": "kb_search", "vector_search": "kb_search",
    "rag": "kb_search",
}


def composite_tag(q: Column) -> Column:
    """The first pattern that a question matches, else an empty string."""
    out = F.lit("")
    for pattern, tag in reversed(COMPOSITE):
        out = F.when(q.rlike("(?i)" + pattern), tag).otherwise(out)
    return F.when(F.coalesce(F.trim(q), F.lit("")) == "", "").otherwise(out)


def complexity(tag: Column) -> Column:
    return F.when(tag != "", "composite").otherwise("simple")


def merged_complexity(tag: Column, judged: Column) -> Column:
    """Struct (complexity, source) of the heuristic's tag and a model's judgement; a weak tag needs the model."""
    model = F.coalesce(judged == "composite", F.lit(False))
    own = (tag != "") & (~tag.isin(WEAK_TAGS) | model)
    source = F.when(own & model, "heuristic+llm").when(own, F.concat(F.lit("heuristic:"), tag)).when(model, "llm").otherwise("simple")
    return F.struct(F.when(own | model, "composite").otherwise("simple").alias("complexity"), source.alias("source"))


def _any(q: Column, needles: list[str]) -> Column:
    low = F.lower(q)
    return sum((F.contains(low, F.lit(n)).cast("int") for n in needles), F.lit(0)) > 0


def intent(q: Column) -> Column:
    """Struct (intent, confidence) by key words."""
    one = lambda name, c: F.struct(F.lit(name).alias("intent"), F.lit(c).alias("confidence"))
    return (
        F.when(_any(q, COMPOUND_WORDS) & _any(q, COMPOUND_ONLY), one("NATURAL_PRODUCTS_ONLY", 0.8))
        .when(_any(q, COMPOUND_WORDS), one("COMBINED_RESEARCH", 0.7))
        .when(_any(q, PAPER_WORDS), one("PAPERS_ONLY", 0.8))
        .otherwise(one("COMBINED_RESEARCH", 0.6))
    )


def tools(q: Column, kb: Column | None = None) -> Column:
    """Suggested tools of the key-word intent, the knowledge base first where one is active."""
    base = (
        F.when(_any(q, COMPOUND_WORDS) & _any(q, COMPOUND_ONLY), F.array(F.lit("lotus_search")))
        .when(_any(q, COMPOUND_WORDS), F.array(F.lit("lotus_search"), F.lit("openalex_search")))
        .when(_any(q, PAPER_WORDS), F.array(F.lit("openalex_search")))
        .otherwise(F.array(F.lit("lotus_search"), F.lit("openalex_search")))
    )
    if kb is None:
        return base
    return F.when((F.coalesce(kb, F.lit("")) != "") & ~F.array_contains(base, "kb_search"), F.array_prepend(base, "kb_search")).otherwise(base)


def cleaned(q: Column) -> Column:
    """A question without the first opening it starts with."""
    return strip(F.regexp_replace(strip(q), "(?i)^(?:" + "|".join(OPENINGS) + ")", ""))


def decomposed(q: Column) -> Column:
    """[topic, topic aspect] of ``topic and (its|their|the) aspect``, else [q]."""
    at = r"(?s)^(.*?)\band\b(?:\s+(?:its|their|the))?\s+(.*)$"
    a, b = strip(F.regexp_extract(q, at, 1)), strip(F.regexp_extract(q, at, 2))
    return F.when((F.length(a) > 5) & (F.length(b) > 3), F.array(a, F.concat(a, F.lit(" "), b))).otherwise(F.array(q))


def subqueries(q: Column) -> Column:
    """Two search phrases of a comparison or an enumeration, else [q]."""
    t = strip(q)
    vs = r"(?is)^(.*?)(?:\s+vs\.?\s+|\s+versus\s+)(.*)$"
    a, b = strip(F.regexp_extract(t, vs, 1)), strip(F.regexp_extract(t, vs, 2))
    d = decomposed(t)
    both = r"(?is)^(.*?)\s+and\s+(.*)$"
    c, e = strip(F.regexp_extract(t, both, 1)), strip(F.regexp_extract(t, both, 2))
    return (
        F.when((F.length(a) > 2) & (F.length(b) > 2), F.array(a, b))
        .when(F.size(d) >= 2, d)
        .when((F.length(c) > 3) & (F.length(e) > 3), F.array(c, e))
        .otherwise(F.array(t))
    )


def _lookup(x: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.element_at(F.create_map(*pairs), x)


def step_type(raw: Column, tool: Column) -> Column:
    """The kind of a plan step from its name, else its tool, else ``literature_search``."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    k, t = key(raw), key(tool)
    return (
        F.when(k.isin(STEP_TYPES), k)
        .when(_lookup(k, STEP_ALIASES).isNotNull(), _lookup(k, STEP_ALIASES))
        .when(_lookup(t, TOOL_ALIASES).isNotNull(), _lookup(t, TOOL_ALIASES))
        .when(t.isin(STEP_TYPES), t)
        .otherwise("literature_search")
    )


def hybrid_weights(answer: Column) -> Column:
    """Struct (vector, bm25) of an answer like ``0.7, 0.3``: the first two numbers, adding up to 1, else one half each."""
    parts = F.filter(F.split(F.regexp_replace(answer, r"[^0-9,.]", ""), ","), lambda p: p != "")
    v, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    fine = v.isNotNull() & b.isNotNull() & (v + b > 0)
    return F.struct(F.when(fine, v / (v + b)).otherwise(0.5).alias("vector"), F.when(fine, b / (v + b)).otherwise(0.5).alias("bm25"))


# Words of questions about an ordered procedure.
WORKFLOW_WORDS = [
    "workflow", "pipeline", "processing pipeline", "procedure", "step by step", "step-by-step", "stages", "methodology", "methods",
    "describe in detail", "explain in detail", "how does", "how do", "architecture", "sequence of", "outline the", "outline of",
]


def seeks_workflow(q: Column) -> Column:
    return _any(F.coalesce(q, F.lit("")), WORKFLOW_WORDS)
