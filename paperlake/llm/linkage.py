"""Records of one paper matched across tables without a common key, each pair with a confidence.

Five matching functions vote on a candidate pair or abstain: title (votes on
titles of fewer than four content words, which many papers can bear, are
votes of their own), people, year, DOI, and kind (a part, reply or correction
is another paper than the one it belongs to). No function sees another's vote and none is given an
accuracy. A generative model, fitted by EM without labels, learns how often
true and false pairs get each vote; votes that depend on each other given the
truth are joined in a tree (the pairs of highest conditional mutual
information), so that agreeing votes are not counted twice. An abstention says
nothing. EM starts from the plain majority of the votes. The posterior is the
pair's confidence.

Only the counts of distinct vote patterns, fewer than 3,000, come to the driver;
the confidences go back as a table of that size.

Defined results: rows with null numbers are left out; a record that has
neither a title nor a DOI matches nothing; copies of a record match alike;
empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm import persons, records
from paperlake.session import cut

VOTES = ["title", "people", "year", "doi", "kind"]
#: The vote of a function that has nothing to say.
ABSTAIN = "none"
#: Votes for and against a match, as EM's start counts them.
FOR = frozenset({"same", "near", "part", "most", "next"})
AGAINST = frozenset({"word", "other", "no"})
#: Pseudo-count of every cell, so that no vote is taken for infallible.
SMOOTH = 0.5
#: Pseudo-count of a vote's shares as such within its shares given another vote.
BACK = 20.0
#: Conditional mutual information (nats) below which two votes count as independent given the truth.
LEAST_INFO = 0.05
#: Steps of EM in which the tree is drawn anew; after them it stays, so that EM settles.
SHAPING = 30
#: Confidence from which a pair counts as found.
FOUND = 0.5


def majority(votes: tuple) -> float:
    """Where EM starts: the share of votes for a match, between 0.1 and 0.9; half if all abstain."""
    yes, no = sum(v in FOR for v in votes), sum(v in AGAINST for v in votes)
    return 0.1 + 0.8 * yes / (yes + no) if yes + no else 0.5


def fit(patterns: list[tuple[tuple, float]], steps: int = 200) -> list[float]:
    """The posterior of a match of each (votes, count)."""
    if not patterns:
        return []
    k = len(patterns[0][0])
    levels = [sorted({v[i] for v, _ in patterns} - {ABSTAIN}) for i in range(k)]
    post = [majority(v) for v, _ in patterns]
    total = sum(n for _, n in patterns)
    last = -math.inf
    for step in range(steps):
        if step < SHAPING:
            tree = _tree(patterns, post, levels)
        share = (sum(n * q for (_, n), q in zip(patterns, post)) + SMOOTH) / (total + 2 * SMOOTH)
        tables = [_table(patterns, post, i, tree[i], levels) for i in range(k)]
        like, new = 0.0, []
        for votes, n in patterns:
            logs = [
                math.log(share if y else 1 - share)
                + sum(math.log(tables[i][y, v, None if tree[i] is None else votes[tree[i]]]) for i, v in enumerate(votes) if v != ABSTAIN)
                for y in (0, 1)
            ]
            top = max(logs)
            z = sum(math.exp(x - top) for x in logs)
            new.append(math.exp(logs[1] - top) / z)
            like += n * (top + math.log(z))
        post = new
        if step > SHAPING and abs(like - last) < 1e-9 * abs(like):
            break
        last = like
    return post


def _table(patterns, post, i, parent, levels) -> dict:
    """P(vote i | truth, parent's vote), smoothed towards P(vote i | truth) and that towards equal shares; abstentions left out."""
    cell: dict = {}
    for (votes, n), q in zip(patterns, post):
        if votes[i] != ABSTAIN:
            p = None if parent is None else votes[parent]
            for y, w in ((0, n * (1 - q)), (1, n * q)):
                cell[y, votes[i], p] = cell.get((y, votes[i], p), 0.0) + w
    out = {}
    for y in (0, 1):
        plain = {v: sum(w for (z, u, _), w in cell.items() if z == y and u == v) + SMOOTH for v in levels[i]}
        total = sum(plain.values())
        for p in [None] if parent is None else [*levels[parent], ABSTAIN]:
            given = sum(cell.get((y, v, p), 0.0) for v in levels[i])
            for v in levels[i]:
                share = plain[v] / total
                alone = parent is None or p == ABSTAIN
                out[y, v, p] = share if alone else (cell.get((y, v, p), 0.0) + BACK * share) / (given + BACK)
    return out


def _tree(patterns, post, levels) -> list[int | None]:
    """The parent of each vote in the maximal forest of conditional mutual information."""
    k = len(levels)
    info = {}
    for i, j in itertools.combinations(range(k), 2):
        joint: dict = {}
        for (votes, n), q in zip(patterns, post):
            if ABSTAIN in (votes[i], votes[j]):
                continue
            for y, w in ((0, n * (1 - q)), (1, n * q)):
                joint[y, votes[i], votes[j]] = joint.get((y, votes[i], votes[j]), 0.0) + w
        total = sum(joint.values()) or 1.0
        my, mi, mj = {}, {}, {}
        for (y, a, b), w in joint.items():
            my[y] = my.get(y, 0.0) + w
            mi[y, a] = mi.get((y, a), 0.0) + w
            mj[y, b] = mj.get((y, b), 0.0) + w
        info[i, j] = sum(
            w / total * math.log(w * my[y] / (mi[y, a] * mj[y, b])) for (y, a, b), w in joint.items() if w > 0
        )
    parent: list[int | None] = [None] * k
    inside = {0}
    while len(inside) < k:
        i, j = max(
            ((a, b) for a in inside for b in range(k) if b not in inside), key=lambda e: info[min(e), max(e)]
        )
        parent[j] = i if info[min(i, j), max(i, j)] > LEAST_INFO else None
        inside.add(j)
    return parent


def votes() -> list[Column]:
    """The votes of a compared pair, each function by itself."""
    title, plain = F.col("title"), F.col("plain")
    return [
        F.when(plain & (title != ABSTAIN), F.concat(F.lit("short "), title)).otherwise(title).alias("title"),
        F.col("people"),
        F.col("year"),
        F.col("doi"),
        F.when(F.col("tag"), ABSTAIN).otherwise("no").alias("kind"),
    ]


def linked(papers: DataFrame, found: DataFrame) -> DataFrame:
    """paper_no, record_no, confidence of every candidate pair."""
    spark = papers.sparkSession
    common = persons.common_given(papers.select(F.explode("authors").alias("x")).select("x.name", "x.given"))
    left = records.forms(papers, 0, "paper_no", "title", "authors", "year", "doi", common)
    right = records.forms(found, 1, "record_no", "title", "author", "date_text", "doi", common)
    rows = cut(left.unionByName(right))
    marked = cut(records.distinct_forms(rows))
    cands, met = records.pairs(marked, across=True)
    some = cut(rows.drop("keys", "text_hash").join(met, ["side", "no"], "left_semi"))
    of = lambda side: some.where(F.col("side") == side)
    voted = cut(records.compared(cands, of(0), of(1)).select("a", "b", *votes()))
    counts = voted.groupBy(*VOTES).count().collect()  # at most one row per pattern
    patterns = [(tuple(r[v] for v in VOTES), float(r["count"])) for r in counts]
    table = spark.createDataFrame(
        [(*p, q) for (p, _), q in zip(patterns, fit(patterns))], ", ".join(f"{v} string" for v in VOTES) + ", confidence double"
    )
    scored = voted.join(F.broadcast(table), VOTES).select("a", "b", "confidence")
    member = lambda side, no, rep: marked.where(F.col("side") == side).select(F.col("no").alias(no), F.col("rep").alias(rep))
    return (
        scored.join(member(0, "paper_no", "a"), "a")
        .join(member(1, "record_no", "b"), "b")
        .select("paper_no", "record_no", F.round("confidence", 6).alias("confidence"))
    )


def pairs(papers: DataFrame, found: DataFrame) -> DataFrame:
    """paper_no, record_no of the pairs with a confidence of FOUND or more."""
    return linked(papers, found).where(F.col("confidence") >= FOUND).select("paper_no", "record_no")
