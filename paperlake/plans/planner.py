"""Research plans: fallback plans, knowledge-base steps, scheduling and progress.

A plan is a short list of steps kept on the driver; ``ready`` works on many
plans as a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.questions import OPENINGS, STEP_ALIASES, STEP_TYPES, TOOL_ALIASES

MAX_REPLANS, MAX_ITERATIONS = 3, 5


@dataclass
class Step:
    id: str
    type: str
    description: str = ""
    tool_input: dict = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)
    condition: str | None = None


def step_type(raw: str | None, tool: str | None = None) -> str:
    k, t = (re.sub(r"[\s-]+", "_", (x or "").strip().lower()) for x in (raw, tool))
    return k if k in STEP_TYPES else STEP_ALIASES.get(k) or TOOL_ALIASES.get(t) or (t if t in STEP_TYPES else "literature_search")


def cleaned(q: str) -> str:
    q = q.strip()
    opening = next((p for p in OPENINGS if q.lower().startswith(p)), "")
    return q[len(opening) :].strip()


def decomposed(q: str) -> list[str]:
    parts = re.split(r"\band\b(?:\s+(?:its|their|the))?\s+", q, maxsplit=1)
    a, b = (parts[0].strip(), parts[1].strip()) if len(parts) == 2 else ("", "")
    return [a, f"{a} {b}"] if len(a) > 5 and len(b) > 3 else [q]


def subqueries(q: str) -> list[str]:
    q = q.strip()
    for pattern, least in ((r"(?i)\s+vs\.?\s+|\s+versus\s+", 2), (None, 0), (r"(?i)\s+and\s+", 3)):
        if pattern is None:
            if len(d := decomposed(q)) > 1:
                return d
            continue
        parts = [p.strip() for p in re.split(pattern, q, maxsplit=1)]
        if len(parts) == 2 and min(map(len, parts)) > least:
            return parts
    return [q]


def fallback(q: str, intent: str, composite: bool = False, kb: str | None = None, tools: tuple[str, ...] = ("lotus_search", "literature_search", "kb_search")) -> list[Step]:
    """A plan without a model: the searches of an intent side by side, then the answer."""
    clean = cleaned(q)
    parts = list(dict.fromkeys(subqueries(clean)))[:3] if composite else None
    wanted: list[tuple[str, list[str]]] = {
        "NATURAL_PRODUCTS_ONLY": [("lotus_search", [clean])],
        "PAPERS_ONLY": [("literature_search", parts or [clean])],
        "COMBINED_RESEARCH": [
            ("kb_search", (parts or [clean]) if kb else []),
            ("lotus_search", [clean]),
            ("literature_search", parts or list(dict.fromkeys(decomposed(clean)))[:3]),
        ],
    }.get(intent, [("literature_search", [clean])])
    searches = [(kind, x) for kind, texts in wanted if kind in tools for x in texts]
    steps = [Step(f"step{i}", kind, tool_input={"query": x}) for i, (kind, x) in enumerate(searches, 1)]
    return [*steps, Step("final", "answer", "Generate answer", depends_on=[s.id for s in steps])]


def kb_first(plan: list[Step], q: str, composite: bool) -> list[Step]:
    """The plan with knowledge-base searches before all else: up to three for a composite question, else one."""
    if any(s.type == "kb_search" for s in plan) and not composite:
        return plan
    phrases = list(dict.fromkeys(subqueries(cleaned(q))))[:3] if composite else [cleaned(q)]
    kb = [Step(f"kb{i}", "kb_search", tool_input={"query": p}) for i, p in enumerate(phrases, 1)]
    rest = [s for s in plan if s.type != "kb_search"]
    first = [k.id for k in kb]
    dropped = {s.id for s in plan} - {s.id for s in rest}
    return kb + [
        Step(s.id, s.type, s.description, s.tool_input, list(dict.fromkeys(first + [d for d in s.depends_on if d not in dropped])), s.condition)
        for s in rest
    ]


def batch(plan: list[Step], done: set[str]) -> list[Step]:
    """Steps whose needs are all done, side by side; an answer that is ready runs alone."""
    free = [s for s in plan if s.id not in done and set(s.depends_on) <= done]
    return [s for s in free if s.type == "answer"][:1] or free


def condition_met(step: Step, results: list[str]) -> bool:
    """A condition on earlier findings holds if one of them is neither empty nor negative."""
    c = (step.condition or "").lower()
    if not c or not ("found" in c or "results" in c):
        return True
    return any(r.strip() and not re.match(r"(?i)\s*(?:no |none|error|failed)", r) for r in results)


def progress(
    remaining: int, gaps: set[str], covered_by_remaining: set[str], searches_left: int, sufficient: bool | None = None,
    confidence: float = 0.0, missing: int = 0, done: int = 0, substantial: bool = False, enough: float = 0.85,
) -> str:
    """``answer``, ``replan`` or ``continue``.

    ``gaps`` are facets with two entries or fewer; ``sufficient`` is a judge's
    word on the latest documents, None without one.
    """
    if not remaining:
        return "answer"
    if gaps and searches_left and gaps - covered_by_remaining:
        return "replan"
    if sufficient and confidence >= enough and not gaps:
        return "answer"
    if sufficient is False and missing and gaps:
        return "replan"
    return "answer" if substantial and done >= 3 else "continue"


def ready(steps: DataFrame, done: DataFrame) -> DataFrame:
    """plan, id of the next steps of many plans at once; steps: plan, id, type, depends_on; done: plan, ids."""
    have = F.coalesce("ids", F.array().cast("array<string>"))
    free = steps.join(done, "plan", "left").where(~F.array_contains(have, F.col("id")) & F.forall("depends_on", lambda x: F.array_contains(have, x)))
    answer = free.groupBy("plan").agg(F.min(F.when(F.col("type") == "answer", F.col("id"))).alias("_a"))
    return free.join(answer, "plan").where(F.col("_a").isNull() | (F.col("id") == F.col("_a"))).select("plan", "id")
