"""The best texts of many questions by their common terms, without a row per pair of a question and a text.

Terms that many texts have in common with many questions are one matrix product
per block of texts; the others are added posting by posting. A task passes on
its own ``k`` best per question only, so the shuffle holds ``k`` rows per
question and task, however many pairs have a term in common. Nothing is left
out that could be among the ``k`` best: a pair is passed over when its score is
below that of ``k`` texts already seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Scores of a block of texts held at a time.
CELLS = 1 << 20
#: A term is part of the matrix from this share of all pairs on; at most DENSE are.
SHARE, DENSE = 0.01, 256
#: Pairs held before the best of them are picked.
POOL = 1 << 19
#: Questions that are shipped to all tasks at once; more are joined block by block.
HELD = 20_000


class Asked:
    """Questions as terms with weights; one entry per question and term."""

    def __init__(self, q: np.ndarray, terms: pa.Array, w: np.ndarray, size: np.ndarray | None = None):
        self.ids, at = np.unique(q, return_inverse=True)
        coded = terms.dictionary_encode()
        t = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(t, kind="stable")
        self.terms, self.t, self.q, self.w = coded.dictionary, t[order], at[order], w[order]
        self.starts = np.searchsorted(self.t, np.arange(len(self.terms) + 1))
        self.size = None
        if size is not None:
            self.size = np.zeros(len(self.ids))
            self.size[at] = size
        #: With weights of 0 or less a sum does not tell whether there was a common term; this counts them.
        self.hits = Asked(q, terms, np.ones(len(w)), None) if len(w) and w.min() <= 0 else None
        self.column = self.matrix = None

    def divide(self, share: np.ndarray) -> None:
        """Choose the terms of the matrix. share: of the texts, by term."""
        pairs = share * np.diff(self.starts) / len(self.ids)
        some = np.argsort(-pairs, kind="stable")[:DENSE]
        some = some[pairs[some] > SHARE]
        self.column = np.full(len(self.terms), -1)
        self.column[some] = np.arange(len(some))
        mine = self.column[self.t] >= 0
        self.matrix = np.zeros((len(some), len(self.ids)))
        self.matrix[self.column[self.t[mine]], self.q[mine]] = self.w[mine]
        if self.hits:
            self.hits.divide(share)

    def sums(self, i: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Sums of products of weights of ``n`` texts (rows) and all questions. i, t, w: text, term and weight of the postings."""
        c = self.column[t]
        dense = c >= 0
        rows = np.zeros((n, len(self.matrix)))
        rows[i[dense], c[dense]] = w[dense]
        out = rows @ self.matrix
        i, t, w = i[~dense], t[~dense], w[~dense]
        many = self.starts[t + 1] - self.starts[t]
        at = np.arange(many.sum()) + np.repeat(self.starts[t] - (np.cumsum(many) - many), many)
        np.add.at(out.reshape(-1), np.repeat(i * len(self.ids), many) + self.q[at], np.repeat(w, many) * self.w[at])
        return out


def _postings(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; text, term and count of each posting of the stated terms, in order of the texts."""
    lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype("int64")
    found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lens)), lens)
    some = found >= 0
    code, tf = np.unique(text[some] * max(1, len(terms)) + found[some], return_counts=True)
    i, t = np.divmod(code, max(1, len(terms)))
    return lens, i, t, tf


def _blocks(lens: np.ndarray, step: int, by_size: bool) -> Iterator[tuple[int, int]]:
    """Spans of at most ``step`` texts; of one size, if asked for."""
    ends = [*(np.flatnonzero(np.diff(lens)) + 1), len(lens)] if by_size else [len(lens)]
    lo = 0
    for end in ends:
        while lo < end:
            yield lo, (hi := min(end, lo + step))
            lo = hi


def _picked(asked: Asked, batches: Iterator, k: int, weigh: Callable | None, digits: int | None, least: float | None) -> list[np.ndarray]:
    """Question, key, score and other columns of the ``k`` best texts of each question. batches: keys, tokens, other columns."""
    n = len(asked.ids)
    slack = 0.0 if digits is None else 1.1 * 10.0**-digits
    floor = least if least is not None else np.finfo("float64").min if asked.hits else np.nextafter(0, 1)
    bar, pool, held, first = np.full(n, floor), [], 0, True

    def best() -> list[np.ndarray]:
        q, key, score, *rest = (np.concatenate(x) for x in zip(*pool))
        by = score if digits is None else np.round(score, digits)
        order = np.lexsort((key, -by, q))
        start = np.searchsorted(q[order], np.arange(n))
        place = np.arange(len(order)) - start[q[order]]
        last = order[place == k - 1]
        bar[q[last]] = np.maximum(bar[q[last]], by[last] - slack)
        order = order[place < k]
        return [x[order] for x in (q, key, score, *rest)]

    for keys, tokens, rest in batches:
        lens, i, t, tf = _postings(tokens, asked.terms)
        if asked.matrix is None:
            asked.divide(np.bincount(t, minlength=len(asked.terms)) / len(lens))
        w = weigh(tf, lens[i]) if weigh else np.ones(len(i))
        if asked.size is not None:
            order = np.argsort(lens, kind="stable")
            at = np.empty_like(order)
            at[order] = np.arange(len(order))
            moved = np.argsort(at[i], kind="stable")
            i, t, w, lens, keys, rest = at[i][moved], t[moved], w[moved], lens[order], keys[order], [x[order] for x in rest]
        for lo, hi in _blocks(lens, max(1, CELLS // n), asked.size is not None):
            a, z = np.searchsorted(i, [lo, hi])
            part = i[a:z] - lo, t[a:z]
            s = asked.sums(*part, w[a:z], hi - lo)
            if asked.hits:
                s[asked.hits.sums(*part, np.ones(z - a), hi - lo) == 0] = -np.inf
            need = bar
            if asked.size is not None:
                most = np.maximum(lens[lo], np.maximum(asked.size, 1))
                need = bar * most * (1 - 1e-12)
            elif first and hi - lo > k:
                bar = need = np.maximum(bar, np.partition(s, hi - lo - k, axis=0)[hi - lo - k] - slack)
            first = False
            at = np.flatnonzero(s >= need)
            d, q = np.divmod(at, n)
            score = s.reshape(-1)[at]
            if asked.size is not None:
                score = score / most[q]
            pool.append([q, keys[lo + d], score, *[x[lo + d] for x in rest]])
            held += len(at)
            if held > 2 * k * n + POOL:
                pool = [best()]
                held = len(pool[0][0])
    if not pool:
        return []
    q, *others = best()
    some = others[1] >= floor
    return [asked.ids[q][some], *[x[some] for x in others]]


def best(
    texts: DataFrame, asked: DataFrame, n: int, k: int, weigh: Callable | None = None, digits: int | None = None, least: float | None = None,
) -> DataFrame:
    """_q, _k, score and further columns of ``texts``: at least the ``k`` best texts of each question with a common term.

    texts: _k (long), _t (array of terms), further columns. asked: _q (long),
    term, w, one row per question and term, of at most ``n`` questions. The
    score is the sum of ``w * weigh(tf, size)``. If ``asked`` has a column
    ``size``, it is divided by the larger of the sizes of question and text.
    Equal scores, rounded to ``digits``, keep the smaller key; scores below
    ``least`` are left out.
    """
    more = [f for f in texts.schema.fields if f.name not in ("_k", "_t")]
    out = StructType([StructField("_q", LongType()), StructField("_k", LongType()), StructField("score", DoubleType()), *more])
    names, sized = [f.name for f in more], "size" in asked.columns
    texts = texts.where("_k IS NOT NULL").select("_k", "_t", *names)
    asked = asked.where("_q IS NOT NULL")

    def made(q: pa.Array, term: pa.Array, w: pa.Array, size: pa.Array | None) -> Asked:
        num = lambda x: x.to_numpy(zero_copy_only=False)
        return Asked(num(q), term, num(w).astype("float64"), num(size).astype("float64") if sized else None)

    def columns(keys: pa.Array, tokens: pa.Array, rest: list[pa.Array]) -> tuple:
        return keys.to_numpy(zero_copy_only=False), tokens, [np.array([*x.to_pylist(), None], dtype=object)[:-1] for x in rest]

    def rows(found: list[np.ndarray], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if found and len(found[0]):
            arrays = [pa.array(x) for x in found[:3]] + [pa.array(x, t) for x, t in zip(found[3:], types)]
            yield pa.RecordBatch.from_arrays(arrays, ["_q", "_k", "score", *names])

    if n <= HELD:
        t = asked.toArrow()
        one = lambda c: pa.concat_arrays([pa.array([], t.column(c).type), *t.column(c).chunks])
        all_ = made(one("_q"), one("term"), one("w"), one("size") if sized else None)

        def run(batches):
            types: list = []

            def each():
                for b in batches:
                    types[:] = [c.type for c in b.columns[2:]]
                    if b.num_rows and len(all_.ids):
                        yield columns(b.column(0), b.column(1), b.columns[2:])

            yield from rows(_picked(all_, each(), k, weigh, digits, least), types)

        return texts.mapInArrow(run, out)

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in b.columns], b.schema.names)

    def against(batches):
        for b in batches:
            for r in range(b.num_rows):
                *cs, qs = (c[r].values for c in b.columns)
                fields = [pc.struct_field(qs, x) for x in (["_q", "term", "w", "size"] if sized else ["_q", "term", "w"])]
                yield from rows(_picked(made(*fields, *([] if sized else [None])), iter([columns(cs[0], cs[1], cs[2:])]), k, weigh, digits, least), [c.type for c in cs[2:]])

    kinds = StructType([StructField(f.name, ArrayType(f.dataType)) for f in texts.schema.fields])
    blocks = asked.groupBy(F.pmod(F.xxhash64("_q"), F.lit(-(-n // HELD))).alias("_b")).agg(F.collect_list(F.struct(*asked.columns)).alias("_qs"))
    return texts.mapInArrow(packed, kinds).crossJoin(blocks.select("_qs")).mapInArrow(against, out)
