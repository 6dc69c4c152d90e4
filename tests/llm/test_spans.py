"""Shared spans against brute force over all windows."""

import random

import numpy as np
import pytest

from paperlake.llm import spans as S


def brute(docs, span):
    win = {}
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            win.setdefault(t[p : p + span], set()).add(i)
    pairs = {(a, b) for s in win.values() for a in s for b in s if a < b}
    cover = {}
    for i, t in docs:
        on = np.zeros(len(t or "") + 1, bool)
        for p in range(len(t or "") - span + 1):
            if len(win[t[p : p + span]]) > 1:
                on[p : p + span] = True
        cover[i] = (int(on.sum()), int((on[1:] & ~on[:-1]).sum() + on[0]))
    return pairs, cover


def corpus(seed, span):
    rnd = random.Random(seed)
    letter = lambda n, abc="abcdefgh é日": "".join(rnd.choice(abc) for _ in range(n))
    parts = [letter(rnd.choice([span - 1, span, span + 1, 2 * span, span // 2])) for _ in range(8)]
    docs = [(i, letter(rnd.randrange(span)) + "".join(rnd.choice(parts) + letter(rnd.randrange(4)) for _ in range(rnd.randrange(4)))) for i in range(30)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, ""), (103, "a" * 3 * span), (104, "a" * span + "b"), (105, "ab" * 2 * span), (106, "b" + "ab" * span)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute(spark, seed):
    span = 20
    docs = corpus(seed, span)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(200, None, "y"), (None, "a" * 50, "z")], "doc_id long, text string, h string")
    pairs, cover = brute(docs, span)
    assert {tuple(r) for r in S.pairs(df, span).collect()} == pairs and pairs
    got = {r.doc_id: (r.shared_chars, r.n_spans) for r in S.coverage(df, span).where("doc_id < 200").collect()}
    assert got == cover


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.pairs(none).count() == 0 and S.coverage(none).count() == 0


def test_long_text_in_stretches(spark, monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghij") for _ in range(5000))
    docs = [text, text[1000:1700], text[2990:3400]]
    powers = S._powers(S._BASES[0], 6000)
    whole = [S.tokens(S._points(t), np.array([len(t)]), 200, powers)[0] for t in docs]
    monkeypatch.setattr(S, "STRETCH", 900)
    for t, w in zip(docs, whole):
        got = set()
        for _, offsets, points, ends in S._batches([t], 200):
            got |= {int(p) + offsets[0] for p in S.tokens(points, ends, 200, powers)[0]}
        assert got == set(w.tolist())
