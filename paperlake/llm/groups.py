"""Connected groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(no, root) of every end of a link (a, b); root is the smallest number of its group.

    Contraction: in each round every node goes to the neighbour (or itself)
    of least hash, drawn anew by the round, and links between the nodes left
    go on. A group whose nodes are all linked is done after one round; of a
    long chain about a third of the nodes is left by each. The steps are then
    taken back from the last round, which has few nodes, to the first. All
    work is on links and nodes, each round is written to the shared folder,
    and nothing but whether links are left comes to the driver. More than
    ``rounds`` rounds are an error.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError("the groups did not settle")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("no"), rank("b").alias("r")).unionByName(edges.select(F.col("b").alias("no"), rank("a").alias("r")))
        least = both.groupBy("no").agg(F.min("r").alias("r"))
        step = cut(least.select("no", F.least("r", rank("no"))["to"].alias("to")))
        steps.append(step)
        u = step.select(F.col("no").alias("a"), F.col("to").alias("u"))
        v = step.select(F.col("no").alias("b"), F.col("to").alias("v"))
        edges = cut(edges.join(u, "a").join(v, "b").where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("no"), F.col("b").alias("root"))
    found = steps[-1].select("no", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        on = found.select(F.col("no").alias("to"), "root")
        found = step.join(on, "to", "left").select("no", F.coalesce("root", "to").alias("root"))
    if len(steps) > 1:
        found = cut(found)
    least = found.groupBy("root").agg(F.min("no").alias("least"))
    return found.join(least, "root").select("no", F.col("least").alias("root"))

