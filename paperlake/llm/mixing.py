"""Sources mixed to target shares of tokens under a limit of repeats.

Natural token shares s and target weights m span the temperature family
w(t) ~ s * (m / s) ** t: t = 0 keeps the corpus as it is, t = 1 meets the
targets. t is bisected in [0, 1]:

- against the limit of repeats: the largest t at which no source needs more
  than ``max_repeats`` passes for a mixture of the wanted size, or, without
  one, for a mixture at least as large as its sources;
- to a target entropy of the weights, stated as a point between the entropies
  of the natural shares and of the targets.

Without a wanted size the mixture is the largest whose weights can all be
met. The weights become token budgets, and each budget is laid out in blocks:
block 0 is one pass over the source's documents, block 1 another in an order
of its own, and so on; the last block ends where the budget does.

Defined results: sources are compared trimmed and in lower case; documents of
no or no listed source, of empty or null text stay out; a source without
tokens gets no budget, its weight falls to the others; null or negative
weights count as 0, null limits as 1; an unfilled catalogue gives no rows.
Repeated documents are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm import tokens as T
from paperlake.session import cut

#: Hash ranges per source within which running sums are taken.
RANGES = 4096


def weights(share: dict[str, float], target: dict[str, float], t: float) -> dict[str, float]:
    """w(t), normalised; a source without tokens or target has weight 0."""
    raw = {s: share[s] * (target[s] / share[s]) ** t if share[s] > 0 and target[s] > 0 else 0.0 for s in share}
    total = sum(raw.values())
    return {s: x / total if total else 0.0 for s, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum((x * math.log(x) for x in w.values() if x > 0), 0.0)


#: Steps in which [0, 1] is looked through before the bisection, as limits need not be met on one side only.
GRID = 1000


def bisected(ok) -> float | None:
    """The largest t in [0, 1] with ``ok(t)`` as far as GRID tells its side from the other, to a double's precision; null if there is none."""
    if ok(1.0):
        return 1.0
    low = next((k / GRID for k in range(GRID - 1, -1, -1) if ok(k / GRID)), None)
    if low is None:
        return None
    high = low + 1 / GRID
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def plan(
    sizes: dict[str, int], target: dict[str, float], repeats: dict[str, int], wanted: float | None = None, evenness: float = 1.0
) -> tuple[dict[str, float], float, float]:
    """(weight of each source, total tokens, exponent t).

    A size that no t reaches gives the largest mixture of all t looked at.
    """
    total = sum(sizes.values())
    share = {s: n / total if total else 0.0 for s, n in sizes.items()}

    def room(t: float) -> float:
        w = weights(share, target, t)
        return min((sizes[s] * repeats[s] / x for s, x in w.items() if x > 0), default=0.0)

    def at(t: float) -> float:
        return entropy(weights(share, target, t))

    size = sum(sizes[s] for s in sizes if target[s] > 0) if wanted is None else wanted
    most = 1.0
    if evenness < 1:
        goal = at(0.0) + (at(1.0) - at(0.0)) * evenness
        most = bisected(lambda t: at(t) <= goal if at(1.0) > at(0.0) else at(t) >= goal) or 0.0
    t = bisected(lambda x: room(x * most) >= size)
    t = max((k / GRID for k in range(GRID + 1)), key=lambda x: room(x * most)) * most if t is None else t * most
    return weights(share, target, t), room(t) if wanted is None else min(wanted, room(t)), t


def mix(
    docs: DataFrame,
    catalog: DataFrame,
    wanted: float | None = None,
    evenness: float = 1.0,
    seed: int = 17,
    tokenizer: str = T.TOKENIZER,
    folder: str = T.TOKENIZER_DIR,
) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents: source_name, block, position (from 0, in the block's own order), doc_id, tokens.
    shares: source_name, mix_weight, max_repeats, documents, tokens, budget,
    exponent, mixed_tokens, share, most_times, entropy.
    """
    spark = docs.sparkSession
    cat = catalog.where("source_name IS NOT NULL").groupBy(F.lower(F.trim("source_name")).alias("source_name")).agg(
        F.greatest(F.coalesce(F.max("mix_weight"), F.lit(0.0)), F.lit(0.0)).alias("mix_weight"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"),
    )
    named = docs.select("doc_id", F.lower(F.trim("source")).alias("source_name"), "text")
    # the catalogue has one row per source; the optimizer broadcasts it by its measured size
    listed = named.join(cat.select("source_name"), "source_name", "left_semi")
    sized = cut(T.count(listed, ["doc_id", "source_name"], "text", tokenizer, folder).where("tokens > 0"))

    per_source = sized.groupBy("source_name").agg(F.sum("tokens").alias("n"))
    found = {r["source_name"]: r for r in cat.join(per_source, "source_name", "left").collect()}  # one row per source
    sizes = {s: int(r["n"] or 0) for s, r in found.items()}
    goal = {s: float(r["mix_weight"]) if sizes[s] else 0.0 for s, r in found.items()}
    w, total, t = plan(sizes, goal, {s: int(r["max_repeats"]) for s, r in found.items()}, wanted, evenness)
    budget = {s: int(w[s] * total) for s in found}
    whole = {s: budget[s] // sizes[s] if sizes[s] else 0 for s in found}
    rows = [(s, whole[s], budget[s] - whole[s] * sizes[s], budget[s], t, entropy(w)) for s in sorted(found)]
    budgets = spark.createDataFrame(rows, "source_name string, whole long, rest long, budget long, exponent double, entropy double")

    # Each block has an order of its own, by a hash drawn anew: first the hash's range, then the hash. Sums per range
    # place a document in its block without any task seeing a whole source.
    passes = sized.join(F.broadcast(budgets.where("budget > 0").select("source_name", "whole", "rest")), "source_name")
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    laid = (
        passes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("h", F.xxhash64(F.lit(seed), "block", "doc_id", "source_name"))
        .withColumn("range", F.pmod(F.shiftright("h", 40), F.lit(RANGES)))
    )
    of = ["source_name", "block"]
    per_range = laid.groupBy(*of, "range").agg(F.sum("tokens").alias("n"), F.count("*").alias("d"))  # at most sources x blocks x RANGES rows
    before = Window.partitionBy(*of).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        *of, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before")
    )
    inside = Window.partitionBy(*of, "range").orderBy("h", "doc_id")
    ended = laid.join(starts, [*of, "range"]).select(
        *of,
        (F.col("docs_before") + F.row_number().over(inside) - 1).alias("position"),
        "doc_id",
        "tokens",
        (F.col("tokens_before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("end"),
        "whole",
        "rest",
    )
    documents = ended.where("block < whole OR end <= rest").drop("end", "whole", "rest")
    per_doc = documents.groupBy("source_name", "doc_id").agg(F.count("*").alias("times"), F.sum("tokens").alias("n"))
    mixed = per_doc.groupBy("source_name").agg(F.sum("n").alias("mixed_tokens"), F.max("times").alias("most_times"))
    held = sized.groupBy("source_name").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    all_tokens = Window.partitionBy()
    joined = cat.join(budgets, "source_name").join(held, "source_name", "left").join(mixed, "source_name", "left")
    fill = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shares = joined.select(
        "source_name", "mix_weight", "max_repeats", fill("documents"), fill("tokens"), "budget", "exponent",
        fill("mixed_tokens"),
        (fill("mixed_tokens") / F.greatest(F.lit(1), F.sum(fill("mixed_tokens")).over(all_tokens))).alias("share"),
        fill("most_times"), "entropy",
    )
    return documents, shares
