"""References to records that do not exist, found per table and passed down the key graph.

``Table`` and ``Reference`` describe the foreign-key graph. ``direct`` finds
each child row whose own reference is missing, deleted or late;
``cascade`` adds the rows that are intact themselves but hang below such a
row, by semi-joins down the graph until nothing changes.

Defined results: rows with the same key are one row with the earliest
``loaded`` and ``deleted``; rows with a null key are no record; a null
reference is no case, and an empty string is a key like any other; a null
time makes no reference deleted or late. Empty tables give no rows, missing
parents only ``missing``. Only the named columns are read, so others with
the same names do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.skew import hot_keys, lookup
from paperlake.session import cut

CASE = "child_table string, fk_field string, row_id string, state string"


@dataclass(frozen=True)
class Table:
    """A table of the graph and the columns that matter; ``at`` is a row's own time."""

    df: DataFrame
    key: str
    at: str | None = None
    deleted: str | None = None
    loaded: str = "loaded_at"


@dataclass(frozen=True)
class Reference:
    child: str
    field: str
    parent: str


@dataclass
class Graph:
    tables: dict[str, Table]
    references: list[Reference]
    records: dict[str, DataFrame] = field(default_factory=dict)
    counted: dict = field(default_factory=dict, repr=False)

    def record(self, name: str) -> DataFrame:
        """One row per key: _id, _at, _loaded, _deleted and the references of the table."""
        if name in self.records:
            return self.records[name]
        t = self.tables[name]
        fields = [r.field for r in self.references if r.child == name]
        none = F.lit(None).cast("timestamp_ntz")
        flat = t.df.where(F.col(t.key).isNotNull()).select(
            F.col(t.key).cast("string").alias("_id"),
            F.col(t.loaded).cast("timestamp_ntz").alias("_loaded"),
            (F.col(t.deleted).cast("timestamp_ntz") if t.deleted else none).alias("_deleted"),
            (F.col(t.at).cast("timestamp_ntz") if t.at else none).alias("_at"),
            *[F.col(f).cast("string").alias(f) for f in fields],
        )
        first = F.min(F.struct(F.col("_loaded").isNull(), "_loaded", "_at", *fields)).alias("f")
        one = flat.groupBy("_id").agg(first, F.min("_deleted").alias("_deleted"))
        self.records[name] = one.select(
            "_id", "_deleted", F.col("f._loaded").alias("_loaded"), F.col("f._at").alias("_at"),
            *[F.col(f"f.{f}").alias(f) for f in fields],
        )
        return self.records[name]

    def hot(self, ref: Reference) -> list:
        """Hot keys of a reference, counted once."""
        if (ref.child, ref.field) not in self.counted:
            t = self.tables[ref.child]
            self.counted[ref.child, ref.field] = hot_keys(t.df.select(F.col(ref.field).cast("string").alias("k")), F.col("k"))
        return self.counted[ref.child, ref.field]

    def levels(self) -> list[str] | None:
        """Tables from parents to children, or None when references form a cycle."""
        done: list[str] = []
        while len(done) < len(self.tables):
            ready = [
                n
                for n in self.tables
                if n not in done and all(r.parent in done for r in self.references if r.child == n)
            ]
            if not ready:
                return None
            done += ready
        return done


def _states(graph: Graph, ref: Reference) -> DataFrame:
    """The child's rows with a reference, ``_state`` null where it is sound."""
    child = graph.record(ref.child).where(F.col(ref.field).isNotNull())
    parent = graph.record(ref.parent).select(
        F.col("_id").alias("_pid"), F.col("_loaded").alias("_ploaded"), F.col("_deleted").alias("_pdeleted")
    )
    state = (
        F.when(F.col("_pid").isNull(), "missing")
        .when(F.col("_pdeleted") <= F.col("_at"), "deleted")
        .when(F.col("_ploaded") > F.col("_loaded"), "late")
    )
    joined = lookup(child, parent, ref.field, "_pid", F.col("_id"), graph.hot(ref))
    return joined.withColumn("_state", state)


def direct(graph: Graph) -> DataFrame:
    """One row per unsound reference: child_table, fk_field, row_id, state, at."""
    parts = [
        _states(graph, r)
        .where(F.col("_state").isNotNull())
        .select(
            F.lit(r.child).alias("child_table"),
            F.lit(r.field).alias("fk_field"),
            F.col("_id").alias("row_id"),
            F.col("_state").alias("state"),
            F.col("_at").alias("at"),
        )
        for r in graph.references
    ]
    return reduce(DataFrame.unionByName, parts)


def cascade(graph: Graph, rounds: int = 100) -> DataFrame:
    """All orphans: child_table, fk_field, row_id, state, at, kind, depth.

    ``kind`` is ``direct`` (state missing, deleted or late, depth 0) or
    ``inherited`` (state null): the reference is sound but its target is an
    orphan of either kind. ``depth`` is the number of steps to the nearest
    direct orphan above. Without cycles one pass down the graph is the
    fixpoint; with cycles the pass is repeated, each round cut from its
    lineage, until no row is added (``rounds`` only guards against a loop
    that could not end; exceeding it is an error).
    """
    own = direct(graph).select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    order = graph.levels()
    if order:
        found = {n: own.where(F.col("child_table") == n) for n in graph.tables}
        for name in order:
            for r in [r for r in graph.references if r.child == name]:
                found[name] = found[name].unionByName(_inherited(graph, r, found[r.parent]))
        return _nearest(reduce(DataFrame.unionByName, [found[n] for n in order]))
    known = cut(own)
    for _ in range(rounds):
        more = [_inherited(graph, r, known.where(F.col("child_table") == r.parent)) for r in graph.references]
        new = cut(
            _nearest(reduce(DataFrame.unionByName, more)).join(
                known, ["child_table", "fk_field", "row_id"], "left_anti"
            )
        )
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError("the cascade did not reach its fixpoint")


def _inherited(graph: Graph, ref: Reference, above: DataFrame) -> DataFrame:
    bad = above.groupBy(F.col("row_id").alias("_oid")).agg(F.min("depth").alias("_depth"))
    sound = _states(graph, ref).where(F.col("_state").isNull())
    hit = lookup(sound, bad, ref.field, "_oid", F.col("_id"), graph.hot(ref), how="inner")
    return hit.select(
        F.lit(ref.child).alias("child_table"),
        F.lit(ref.field).alias("fk_field"),
        F.col("_id").alias("row_id"),
        F.lit(None).cast("string").alias("state"),
        F.col("_at").alias("at"),
        F.lit("inherited").alias("kind"),
        (F.col("_depth") + 1).alias("depth"),
    )


def _nearest(df: DataFrame) -> DataFrame:
    keys = ["child_table", "fk_field", "row_id"]
    best = df.groupBy(*keys).agg(F.min(F.struct("depth", "kind", "state", "at")).alias("b"))
    return best.select(*keys, "b.state", "b.at", "b.kind", "b.depth")


def report(orphans: DataFrame) -> DataFrame:
    """Counts per child table, field, month of the child's time, kind and state."""
    return orphans.groupBy(
        "child_table",
        "fk_field",
        F.date_format("at", "yyyy-MM").alias("month"),
        "kind",
        F.coalesce("state", F.lit("inherited")).alias("state"),
    ).agg(F.count("*").alias("n"))


def chat_graph(messages: DataFrame, conversations: DataFrame, sessions: DataFrame, kbs: DataFrame) -> Graph:
    """The key graph of the chat tables."""
    return Graph(
        {
            "sessions": Table(sessions, "id", "created_at", "deleted_at"),
            "kb_metadata": Table(kbs, "name", "created_at", "deleted_at"),
            "conversations": Table(conversations, "id", "created_at", "deleted_at"),
            "messages": Table(messages, "id", "timestamp"),
        },
        [
            Reference("conversations", "session_id", "sessions"),
            Reference("conversations", "kb_name", "kb_metadata"),
            Reference("messages", "conversation_id", "conversations"),
        ],
    )
