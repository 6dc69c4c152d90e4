"""Name entries that mean the same person or organisation.

1. Names are read into a folded family name (or an organisation's key) and
   given parts. The given names common in the corpus, counted first, tell
   which part of an unmarked name is which.
2. Distinct family names are joined by a true edit metric (Damerau-Levenshtein,
   radius 1) in a partition of the metric space: the pivots are the strings one
   deletion away, each name is replicated to every pivot within distance 1 of
   it, and by the triangle inequality two names of one cell are at most 2 apart
   while names within the radius share a cell. A cell of distinct names is
   bounded by the alphabet times the length. Rarer spellings take the most
   frequent neighbour as their canonical form.
3. The distinct given forms of a canonical family are gathered to persons, the
   fullest forms first. A form that fits several persons, or only a middle
   name, is settled entry by entry: the person with whom the entry's paper
   shares most co-authors.

Only distinct forms are grouped, never the rows of a family, so a family with
a third of all rows is no larger than its spellings.

Defined results: null, blank and placeholder names mean nobody and are in no
pair; two entries of one paper are never the same; rows with a null
``author_no`` are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm import names as N
from paperlake.operators.skew import dealt
from paperlake.session import cut, spread

#: Given names with at least this share of all given parts are common; bounds them to 1 / share.
COMMON_SHARE = 1e-4
COMMON_LEAST = 5
#: In family names shorter than this only a swap or a letter typed twice counts; any other edit makes another name of them (Wang, Wong).
SHORT = 5

READ = "author_no long, paper_no long, kind string, family string, given string"


# Accented letters and what stands for them, one to one.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīıłñńňòóôõöøōőŕřśşšťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorrssstuuuuuuuyyzzz"


def common_given(entries: DataFrame) -> frozenset[str]:
    """Folded given names that are common where their place is certain (after a comma, or in ``given``)."""
    parts = F.array(F.regexp_extract("name", ",(.*)$", 1), F.coalesce("given", F.lit("")))
    text = F.translate(F.lower(F.concat_ws(" ", parts)), ACCENTED, PLAIN)
    words = entries.select(F.explode(F.regexp_extract_all(text, F.lit("(?<![^\\s,-])[a-z]{3,}(?![^\\s,-])"), F.lit(0))).alias("w")).groupBy("w").count().persist()
    total = words.agg(F.sum("count")).first()[0] or 0
    need = max(COMMON_LEAST, total * COMMON_SHARE)
    found = frozenset(r[0] for r in words.where(F.col("count") >= need).select("w").collect())
    words.unpersist()
    return found


def read_entries(entries: DataFrame, common: frozenset[str]) -> DataFrame:
    """READ for each entry that names somebody; ``given`` is its parts with a space between them."""

    def run(batches):
        known = N.Known(common)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            rows = []
            for no, paper, name, given, family in zip(*cols):
                n = N.read(name, given, family, known)
                if n.kind != "none" and (n.family or n.kind == "org"):
                    rows.append((no, paper, n.kind, n.family, " ".join(n.given)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), *[pa.string()] * 3])],
                ["author_no", "paper_no", "kind", "family", "given"],
            )

    some = entries.where("author_no IS NOT NULL")
    return spread(some.select("author_no", "paper_no", "name", "given", "family")).mapInArrow(run, READ)


def radius_join(words: DataFrame) -> DataFrame:
    """(a, b), a <> b, of all pairs of ``words.w`` (distinct) at Damerau-Levenshtein distance 1."""
    n = F.length("w")
    deletions = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, n)))
    cells = words.where(n >= 3).select("w", F.explode(F.array_distinct(F.concat(F.array("w"), deletions))).alias("pivot"))
    full = cells.groupBy("pivot").agg(F.collect_list("w").alias("ws")).where(F.size("ws") > 1)
    pairs = full.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).where("a < b").distinct()

    def run(batches):
        for b in batches:
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = [N.near(p, q) and (min(len(p), len(q)) >= SHORT or _slip(p, q)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, k in zip(x, keep) if k], pa.string()), pa.array([q for q, k in zip(y, keep) if k], pa.string())], ["a", "b"]
            )

    half = pairs.mapInArrow(run, "a string, b string")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _slip(a: str, b: str) -> bool:
    """Whether two near names differ by a swap of two letters or one letter typed twice."""
    return sorted(a) == sorted(b) or re.sub(r"(.)\1", r"\1", a) == re.sub(r"(.)\1", r"\1", b)


def canonical(words: DataFrame) -> DataFrame:
    """(w, canon) of each of ``words`` (w, n): the most frequent name within the radius, followed to the end.

    A name follows a neighbour only if that one is more frequent (at equal
    counts: smaller), so the steps never turn back. Each round doubles the
    steps taken, until none is left.
    """
    links = radius_join(words.select("w"))
    weigh = words.select(F.col("w").alias("b"), "n")
    best = links.join(weigh, "b").groupBy("a").agg(F.max_by(F.struct("b", "n"), F.struct("n", F.hash("b"), "b")).alias("m"))
    step = cut(
        words.join(best, words["w"] == best["a"], "left").select(
            "w",
            F.when(
                (F.col("m.n") > F.col("n")) | ((F.col("m.n") == F.col("n")) & (F.col("m.b") < F.col("w"))), F.col("m.b")
            )
            .otherwise(F.col("w"))
            .alias("canon"),
        )
    )
    while True:
        on = step.select(F.col("w").alias("canon"), F.col("canon").alias("next"))
        further = cut(step.join(on, "canon").select("w", F.col("next").alias("canon"), (F.col("next") != F.col("canon")).alias("moved")))
        step = further.select("w", "canon")
        if further.where("moved").isEmpty():
            return step


class _Found:
    """Persons by what a given part that fits theirs must have in common with it."""

    def __init__(self):
        self.at: dict[str, set[int]] = {}

    @staticmethod
    def _cuts(w: str) -> list[str]:
        return ["D" + w, *("D" + w[:i] + w[i + 1 :] for i in range(len(w)))] if len(w) > 2 else []

    def put(self, part: str, person: int) -> None:
        w = part.rstrip(".")
        if len(w) == 1:
            keys = ["I" + w]
        else:
            full = N.NICKNAMES.get(w, "").split()
            keys = ["N" + w, "L" + w[0], *("N" + f for f in full), *("L" + f[0] for f in full), *("S" + f[0] for f in N.SHORT.get(w, ())), *self._cuts(w)]
            if part.endswith("."):
                keys.append("A" + w[0])
        for k in keys:
            self.at.setdefault(k, set()).add(person)

    def get(self, part: str) -> set[int]:
        w = part.rstrip(".")
        if len(w) == 1:
            keys = ["I" + w, "L" + w, "S" + w]
        else:
            full = N.NICKNAMES.get(w, "").split()
            keys = ["N" + w, *("N" + f for f in full), "I" + w[0], *("I" + f[0] for f in full), *("I" + f[0] for f in N.SHORT.get(w, ())), "A" + w[0], *self._cuts(w)]
            if part.endswith("."):
                keys.append("L" + w[0])
        return set().union(*(self.at[k] for k in keys if k in self.at))


def gather(forms: list[tuple[str, int]]) -> list[tuple[str, list[int], bool]]:
    """(form, candidate persons, sure) of each given form of one family, with its count.

    Fuller forms found persons; a later form joins the one it fits, which
    takes its longer parts, or waits for the context if it fits several. Only
    persons that can fit by the first or second part are looked at.
    """

    def fullness(g: tuple[str, ...]):
        letters = [len(p.rstrip(".")) for p in g]
        return (sum(x > 1 for x in letters), len(g), sum(letters))

    people: list[list[str]] = []
    first, second = _Found(), _Found()
    out = []
    ordered = sorted(((tuple(f.split()), n, f) for f, n in forms), key=lambda x: (*[-v for v in fullness(x[0])], -x[1], x[2]))
    for g, _, text in ordered:
        if not g:
            out.append((text, list(range(len(people))), len(people) == 1))
            continue
        fit = [(N.fits(tuple(people[i]), g), i) for i in sorted(first.get(g[0]))]
        best = max((f for f, _ in fit), default=0)
        hits = [i for f, i in fit if f == best and f > 0]
        if len(hits) == 1:
            p = people[hits[0]]
            for i, part in enumerate(g):
                if i >= len(p):
                    p.append(part)
                elif len(part.rstrip(".")) > len(p[i].rstrip(".")) and part.rstrip(".") not in N.NICKNAMES:
                    p[i] = part
            for found, part in zip((first, second), p):
                found.put(part, hits[0])
            out.append((text, hits, True))
        elif hits:
            out.append((text, hits, False))
        else:
            near = sorted(first.get(g[0]) | second.get(g[0]))
            middle = [i for i in near if (len(p := people[i]) > 1 and N.fits(tuple(p[1:]), g)) or N.loosely(tuple(p), g)]
            people.append(list(g))
            for found, part in zip((first, second), g):
                found.put(part, len(people) - 1)
            out.append((text, [len(people) - 1, *middle], not middle))
    return out


def _candidates(forms: DataFrame) -> DataFrame:
    """canon, given, persons (array of int), sure of the distinct forms (canon, given, n)."""

    def run(batches):
        key, held = None, []

        def done():
            got = gather(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * len(got), pa.string()), pa.array([g for g, _, _ in got], pa.string()),
                 pa.array([c for _, c, _ in got], pa.list_(pa.int32())), pa.array([s for _, _, s in got], pa.bool_())],
                ["canon", "given", "persons", "sure"],
            )

        pending: list[pa.RecordBatch] = []
        for b in batches:
            for canon, given, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if canon != key:
                    if held:
                        pending.append(done())
                    key, held = canon, []
                    if len(pending) >= 2000:
                        yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
                        pending = []
                held.append((given, n))
        if held:
            pending.append(done())
        if pending:
            yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]

    by_family = forms.repartition("canon").sortWithinPartitions("canon", "given").select("canon", "given", "n")
    return by_family.mapInArrow(run, "canon string, given string, persons array<int>, sure boolean")


def entities(entries: DataFrame) -> DataFrame:
    """author_no, paper_no, entity (string) of each entry that names somebody."""
    read = cut(read_entries(entries, common_given(entries)))
    named = read.where("family <> ''")
    words = named.groupBy(F.col("family").alias("w"), "kind").agg(F.count("*").alias("n"))
    canon = cut(canonical(words.groupBy("w").agg(F.sum("n").alias("n"))))

    people = read.where("kind = 'person'").join(canon, F.col("family") == F.col("w")).drop("w", "family")
    people = cut(people.select("author_no", "paper_no", "canon", "given"))
    forms = people.groupBy("canon", "given").agg(F.count("*").alias("n"))
    settled = people.join(_candidates(forms), ["canon", "given"])
    settled = cut(settled)
    sure = settled.where("sure").select("author_no", "paper_no", "canon", F.element_at("persons", 1).alias("person"))
    open_ = settled.where("NOT sure").select("author_no", "paper_no", "canon", "given", "persons")

    # co-authors of an entry, the other families of its paper, for the families that have open entries only
    asking = open_.select("canon").distinct()
    fams = people.groupBy("paper_no").agg(F.collect_set("canon").alias("with"))
    company = lambda df: df.join(fams, "paper_no").select("*", F.explode("with").alias("c")).where("c <> canon").drop("with")
    known = company(sure.join(asking, "canon", "left_semi")).groupBy("canon", "c", "person").agg(F.count("*").alias("times"))
    asked = company(open_).select("author_no", "canon", "c", "persons")
    votes = (
        asked.join(known, ["canon", "c"])
        .where(F.array_contains("persons", F.col("person")))
        .groupBy("author_no", "person")
        .agg(F.count("*").alias("shared"), F.sum("times").alias("times"))
    )
    chosen = votes.groupBy("author_no").agg(F.max_by("person", F.struct("shared", "times", -F.col("person"))).alias("person"))
    placed = open_.join(chosen, "author_no", "left").select(
        "author_no",
        "paper_no",
        F.when(F.col("person").isNotNull(), F.concat_ws("|", "canon", "person"))
        .when(F.col("given") == "", F.concat_ws("|", F.lit("alone"), "author_no"))
        .otherwise(F.concat_ws("|", "canon", "given"))
        .alias("entity"),
    )
    persons = sure.select("author_no", "paper_no", F.concat_ws("|", "canon", "person").alias("entity")).unionByName(placed)

    orgs = read.where("kind = 'org'")
    spelt = orgs.where("family <> ''").join(canon, F.col("family") == F.col("w")).select("author_no", "paper_no", "canon", "given")
    acronyms = (
        spelt.groupBy("canon", "given").count()
        .groupBy("given").agg(F.collect_set("canon").alias("canons"))  # organisations of one acronym: distinct names only
    )
    short = orgs.where("family = ''").select(
        "author_no",
        "paper_no",
        F.substring_index("given", " ", 1).alias("given"),
        F.when(F.col("given").contains(" "), F.substring_index("given", " ", -1)).otherwise("").alias("place"),
    )
    meant = short.join(acronyms, "given", "left").withColumn(
        "canons", F.filter("canons", lambda c: c.startswith(F.col("place")))
    )
    spelt_id = spelt.select("author_no", "paper_no", F.concat(F.lit("org|"), "canon").alias("entity"))
    short_id = meant.select(
        "author_no",
        "paper_no",
        F.when(F.size("canons") == 1, F.concat(F.lit("org|"), F.element_at("canons", 1)))
        .otherwise(F.concat_ws("|", F.lit("acronym"), "given", "place"))
        .alias("entity"),
    )
    return persons.unionByName(spelt_id).unionByName(short_id)


def classes(entries: DataFrame) -> DataFrame:
    """author_no, class_no (the smallest author_no of its entity), entries (of the class) of each entry that names somebody."""
    who = cut(entities(entries).select("author_no", "entity"))
    sizes = who.groupBy("entity").agg(F.min("author_no").alias("class_no"), F.count("*").alias("entries"))
    return who.join(sizes, "entity").select("author_no", "class_no", "entries")


def pairs(entries: DataFrame) -> DataFrame:
    """author_no_a < author_no_b of entries of one entity, in different papers, whose names differ.

    An entity of many entries is dealt to several tasks.
    """
    who = cut(entities(entries).join(entries.select("author_no", "name"), "author_no"))
    left, right = dealt(who, ["entity"], "author_no")
    a = left.select("entity", "_slice", F.col("author_no").alias("author_no_a"), F.col("name").alias("na"), F.col("paper_no").alias("pa"))
    b = right.select("entity", "_slice", F.col("author_no").alias("author_no_b"), F.col("name").alias("nb"), F.col("paper_no").alias("pb"))
    return (
        a.join(b, ["entity", "_slice"])
        .where("author_no_a < author_no_b AND NOT (na <=> nb) AND NOT (pa <=> pb)")
        .select("author_no_a", "author_no_b")
    )
