"""Long exact spans shared between texts, by compaction of a de Bruijn graph.

1. Copies of a whole text are one text from here on; no text is moved for it.
2. A token is a *minimizer*: a k-mer of K characters whose hash is least among
   W neighbours. With K + W - 1 = SPAN every span of SPAN characters holds the
   same tokens at the same places in every text, and neighbouring tokens
   overlap or touch, so equal tokens at equal distances mean equal text.
3. Tokens found in one text only are dropped. The others are the nodes; each
   pair of neighbouring tokens of a text is an edge labelled by its distance.
4. A node whose every occurrence has the same predecessor, as often as that
   one occurs, continues its path; the rest start a path. These two joins
   compact nonbranching paths: each occurrence of a path is one interval of
   source coordinates.
5. The texts are read at these coordinates. A path of SPAN characters or more
   gives one key of 128 bits over its text; from a shorter path, which may
   still lie inside a longer shared span, come the keys of all windows of SPAN
   characters around it. Texts with a common key share a span.
6. Of keys with the same set of texts one is kept, and its texts are paired,
   those of a key of many texts in several tasks.

A text repeated any number of times, a boilerplate shorter than SPAN or a hot
token makes no pairs, only rows of counts combined before the shuffle.

Defined results: null texts and texts below SPAN characters share nothing; a
span repeated inside one text alone is not shared; characters are Unicode
code points, unchanged. Documents with a null key are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.skew import dealt
from paperlake.session import cut, spread

SPAN = 200
#: Characters hashed at once; bounds a Python worker's memory whatever a text's length.
STRETCH = 1_000_000


def sizes(span: int) -> tuple[int, int]:
    """(K, W) with K + W - 1 = span and W <= K, so that neighbouring tokens leave no gap."""
    w = span // 2
    return span - w + 1, w


# Odd multipliers of the rolling hashes and of the finishing mix.
_BASES = (6364136223846793005, 2862933555777941757)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(_MIX[1])
    x = (x ^ (x >> _u(27))) * _u(_MIX[2])
    return x ^ (x >> _u(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rolled(points: np.ndarray, k: int, base: int, powers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the windows of ``k`` points, the same for the same content anywhere."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    x = _mix(points.astype(np.uint64) * _u(_MIX[0]) + _u(base))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * powers[:n], dtype=np.uint64, out=total[1:])
    m = n - k + 1
    return _mix((total[k:] - total[:m]) * powers[n - np.arange(m)] * _inverse(powers, n))


def _inverse(powers: np.ndarray, n: int) -> np.uint64:
    """1 / base ** n modulo 2 ** 64, which makes hashes independent of the stretch's length."""
    return _u(pow(int(powers[n]), -1, 1 << 64))


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``w`` neighbours."""
    size, y = 1, x
    while size * 2 <= w:
        y = f(y[:-size], y[size:])
        size *= 2
    rest = w - size
    return f(y[: len(y) - rest], y[rest:]) if rest else y


def tokens(points: np.ndarray, ends: np.ndarray, span: int, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the minimizers in texts that lie one after another, ending at ``ends``."""
    k, w = sizes(span)
    h = _rolled(points, k, _BASES[0], powers)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _slide(h, w, np.minimum)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    for a, b in zip(starts, ends - span + 1):
        if b > a:
            inside[a] += 1
            inside[b] -= 1
    least[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)
    places = np.nonzero(most == h)[0]
    return places, h[places]


def _batches(texts: list[str], span: int):
    """Stretches of whole texts, or of one long text with an overlap: (rows, offsets, points, ends)."""
    rows, parts, n = [], [], 0
    for i, t in enumerate(texts):
        p = _points(t)
        if len(p) > STRETCH:
            step = STRETCH - span + 1
            for a in range(0, len(p) - span + 1, step):
                part = p[a : a + STRETCH]
                yield [i], [a], part, np.array([len(part)])
            continue
        if n + len(p) > STRETCH and parts:
            yield rows, [0] * len(rows), np.concatenate(parts), np.cumsum([len(x) for x in parts])
            rows, parts, n = [], [], 0
        rows.append(i)
        parts.append(p)
        n += len(p)
    if parts:
        yield rows, [0] * len(rows), np.concatenate(parts), np.cumsum([len(x) for x in parts])


def token_rows(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, h, pos, ord of every token; ``docs`` has doc_id and text of ``span`` characters or more."""

    def run(batches):
        powers = _powers(_BASES[0], STRETCH)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 1024):
                texts = b.column(1).slice(i, 1024).to_pylist()
                got: dict[str, list] = {"r": [], "h": [], "p": []}
                for rows, offsets, points, ends in _batches(texts, span):
                    places, h = tokens(points, ends, span, powers)
                    which = np.searchsorted(ends, places, side="right")
                    starts = np.concatenate([[0], ends[:-1]]) - np.array(offsets)
                    got["r"].append(np.array(rows)[which])
                    got["h"].append(h)
                    got["p"].append(places - starts[which])
                if not got["r"]:
                    continue
                r, h, p = (np.concatenate(got[x]) for x in "rhp")
                if not len(r):
                    continue
                order = np.lexsort((p, r))
                r, h, p = r[order], h[order], p[order]
                new = np.ones(len(r), bool)  # a token in the overlap of two stretches counts once
                new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
                r, h, p = r[new], h[new], p[new]
                first = np.searchsorted(r, r, side="left")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i + r], pa.int64()),
                        pa.array(h.view(np.int64)),
                        pa.array(p.astype(np.int32)),
                        pa.array((np.arange(len(r)) - first).astype(np.int32)),
                    ],
                    ["doc_id", "h", "pos", "ord"],
                )

    return spread(docs).mapInArrow(run, "doc_id long, h long, pos int, ord int")


def paths(nodes: DataFrame, span: int) -> DataFrame:
    """doc_id, path, start, end: every occurrence of a compacted path.

    ``nodes`` are the tokens (doc_id, h, pos, ord). Hot tokens are rows of a
    sort-merge join against one row per token, which the runtime splits.
    """
    k, _ = sizes(span)
    shared = (
        nodes.groupBy("h")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi")
        .select("h", "n")
    )
    kept = cut(nodes.join(shared, "h"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag(F.struct("h", "n", "pos", "ord")).over(w)
    linked = kept.withColumn("b", before).withColumn(
        "edge",
        F.when(
            F.col("b.ord") == F.col("ord") - 1,
            F.struct(F.col("b.h").alias("h"), (F.col("pos") - F.col("b.pos")).alias("gap"), F.col("b.n").alias("n")),
        ),
    )
    inner = (
        linked.groupBy("h")
        .agg(
            F.min("edge").alias("e0"),
            F.max("edge").alias("e1"),
            F.count("edge").alias("with_edge"),
            F.count("*").alias("n"),
        )
        .where("with_edge = n AND e0 = e1 AND e0.n = n")
        .select("h", F.lit(True).alias("inner"))
    )
    marked = linked.select("doc_id", "h", "pos").join(inner, "h", "left")
    begin = F.col("inner").isNull()
    numbered = marked.withColumn("no", F.sum(begin.cast("int")).over(w))
    return (
        numbered.groupBy("doc_id", "no")
        .agg(F.min_by("h", "pos").alias("path"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
        .select("doc_id", "path", "start", "end")
    )


def keys(docs: DataFrame, found: DataFrame, span: int, edges: bool) -> DataFrame:
    """doc_id, k1, k2, start, size of the spans to compare, read from the texts at the paths' coordinates.

    ``edges``: also the windows over the ends of long paths, which settle
    how far beyond them a shared span reaches (not needed for pairs).
    """
    per_doc = found.groupBy(F.col("doc_id").alias("_d")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at")  # bounded by one text's length
    )
    k, _ = sizes(span)

    def run(batches):
        import xxhash

        for b in batches:
            ids, texts, at = (b.column(i).to_pylist() for i in range(3))
            for doc, text, where in zip(ids, texts, at):
                points = _points(text)
                wanted = np.zeros(len(points) - span + 2, np.int32)
                out: list[tuple[int, int, int, int]] = []

                def want(a: int, z: int) -> None:
                    a, z = max(a, 0), min(z, len(points) - span)
                    if a <= z:
                        wanted[a] += 1
                        wanted[z + 1] -= 1

                for s, e in ((x["start"], x["end"]) for x in where):
                    if e - s >= span:
                        d = xxhash.xxh3_128_intdigest(points[s:e].tobytes())
                        out.append((d >> 64, d & (1 << 64) - 1, s, e - s))
                        if edges:
                            want(s + k - span, s - 1)
                            want(e - span + 1, e - k)
                    elif edges:
                        want(s + k - span, e - k)
                    else:
                        want(e - span, s)
                starts = np.nonzero(np.cumsum(wanted[:-1]) > 0)[0]
                yield from _rows(doc, points, starts, out, span)

    joined = docs.join(per_doc, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "at")
    return joined.mapInArrow(run, "doc_id long, k1 long, k2 long, start int, size int")


def _rows(doc: int, points: np.ndarray, starts: np.ndarray, whole: list, span: int):
    """Record batches of one text's keys, its windows hashed run by run."""
    runs = np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1) if len(starts) else []
    cols: list[list] = [[], [], [], []]
    for r in runs:
        for a in range(int(r[0]), int(r[-1]) + 1, STRETCH):
            z = min(int(r[-1]), a + STRETCH - 1)
            part = points[a : z + span]
            powers = [_powers(base, len(part)) for base in _BASES]
            hs = [_rolled(part, span, base, p) for base, p in zip(_BASES, powers)]
            for c, x in zip(cols, (*hs, np.arange(a, z + 1), np.full(z - a + 1, span))):
                c.append(x)
    if whole:
        for c, x in zip(cols, zip(*whole)):
            c.append(np.array(x, np.uint64))
    if cols[0]:
        k1, k2 = (np.concatenate(c).astype(np.uint64).view(np.int64) for c in cols[:2])
        start, size = (np.concatenate([x.astype(np.int32) for x in c]) for c in cols[2:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k1), doc, np.int64)), pa.array(k1), pa.array(k2), pa.array(start), pa.array(size)],
            ["doc_id", "k1", "k2", "start", "size"],
        )


def texts_once(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of one document of each text of ``span`` characters or more, and (doc_id, rep) of all.

    The text itself is not shuffled: its digest finds the representative
    (the smallest doc_id), whose row is then kept by a semi-join on doc_id.
    """
    long = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND length(text) >= %d" % span)
    digest = long.select("doc_id", F.md5("text").alias("m"), F.xxhash64("text").alias("x"))
    reps = digest.groupBy("m", "x").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = digest.join(reps, ["m", "x"]).select("doc_id", "rep", "copies")
    return long, members


def candidates(docs: DataFrame, span: int = SPAN, edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, spans): members doc_id, rep, copies; spans the keys of representatives that two or more share."""
    long, members = texts_once(docs, span)
    members = cut(members)
    reps = members.where("doc_id = rep").select("doc_id")
    nodes = cut(token_rows(long, span).join(reps, "doc_id", "left_semi"))
    found = paths(nodes, span)
    spans = keys(long, found, span, edges)
    return members, spans


def pairs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id_a < doc_id_b of documents that share at least one span of ``span`` characters."""
    members, spans = candidates(docs, span)
    once = cut(spans.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("times")))
    sets = once.groupBy("k1", "k2").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(span), "doc_id", F.lit(1))).alias("x2"),
    )
    one = sets.where("n > 1").groupBy("n", "x1", "x2").agg(F.min(F.struct("k1", "k2")).alias("k"))
    chosen = one.select("k.k1", "k.k2")
    rows = cut(once.join(chosen, ["k1", "k2"], "left_semi").select("k1", "k2", "doc_id"))
    left, right = dealt(rows, ["k1", "k2"], "doc_id")
    both = left.withColumnRenamed("doc_id", "a").join(right.withColumnRenamed("doc_id", "b"), ["k1", "k2", "_slice"])
    linked = both.where("a < b").select("a", "b").distinct()

    # copies of the two texts, and copies of one text among each other
    ma = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("da"))
    mb = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("db"))
    across = linked.join(ma, "a").join(mb, "b").select("da", "db")
    left, right = dealt(members.where("copies > 1").select("rep", "doc_id"), ["rep"], "doc_id")
    both = left.withColumnRenamed("doc_id", "da").join(right.withColumnRenamed("doc_id", "db"), ["rep", "_slice"])
    same = both.where("da < db").select("da", "db")
    return across.unionByName(same).select(
        F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")
    )


def coverage(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars, n_spans, shared_chars, share: how much of each text lies in spans it shares.

    Null texts have null ``n_chars`` and share nothing.
    """
    members, spans = candidates(docs, span, edges=True)
    spans = cut(spans)
    shared = (
        spans.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi")
        .select("k1", "k2")
    )
    hit = spans.join(shared, ["k1", "k2"], "left_semi").select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(w)
    merged = hit.withColumn("reached", reached)
    per_text = merged.groupBy(F.col("doc_id").alias("rep")).agg(
        F.count_if(F.col("reached").isNull() | (F.col("start") > F.col("reached"))).alias("n_spans"),
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("reached", F.lit(0))))).alias("shared_chars"),
    )
    of_doc = members.join(per_text, "rep", "left").select(F.col("doc_id").alias("_d"), "copies", "n_spans", "shared_chars")
    base = docs.where("doc_id IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    copied = F.coalesce(F.col("copies"), F.lit(1)) > 1
    shared_chars = F.when(copied, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
    return base.join(of_doc, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id",
        "n_chars",
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        shared_chars.cast("long").alias("shared_chars"),
        F.round(shared_chars / F.greatest("n_chars", F.lit(1)), 6).alias("share"),
    )
