"""Encoding against a second library and its own round trip; mixing to weights."""

import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import mixing, tokens

here = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
TEXTS = ["", None, "Hello  world\n\n", "<|endoftext|> x", "it's 10.5 µm — ok", "日本語テスト", "a" * 3000, " " * 500 + "x", "\u0000​﻿", "é" * 70 + " \t\n" * 60]


@here
@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200) | st.text("ab 1.\n'", max_size=200), st.integers(1, 20))
def test_pieces(text, size):
    enc = tokens.encoding()
    whole = enc.encode_ordinary(text)
    assert tokens.encode_text(enc, text, size) == whole
    assert "".join(tokens.pieces(text, size)) == text
    assert enc.decode_bytes(whole) == text.encode()


@here
def test_encode(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert all(rows[i] == other.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS))
    back = {r.doc_id: bytes(r.bytes) for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
    assert tokens.encode(df.where("doc_id > 99")).count() == 0


CAT = "source_name string, trust_rank int, mix_weight double, max_repeats int, doc_id string"


@here
def test_mix(spark):
    docs = [(i, f"word {i} " * (1 + i % 7), "Big " if i < 300 else "small" if i < 330 else "odd" if i < 340 else None, 0.1) for i in range(350)]
    docs += [(900, None, "big", 0.0), (901, "", "small", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens double")
    cat = spark.createDataFrame([("big", 1, 0.6, 1, ""), ("small", 2, 0.3, 4, ""), ("none", 3, 0.1, 2, ""), (None, 4, 0.1, 1, "")], CAT)
    rows, shares = mixing.mix(d, cat)
    rows, shares = rows.collect(), {r.source_name: r for r in shares.collect()}
    assert {r.source_name for r in rows} == {"big", "small"}
    assert shares["none"].mixed_tokens == 0 and set(shares) == {"big", "small", "none"}
    assert shares["big"].share == pytest.approx(2 / 3, abs=0.02) and shares["small"].share == pytest.approx(1 / 3, abs=0.02)
    for s in ("big", "small"):
        mine = [r for r in rows if r.source_name == s]
        times = Counter(r.doc_id for r in mine)
        assert sum(r.tokens for r in mine) == shares[s].mixed_tokens <= shares[s].budget
        assert max(times.values()) == shares[s].most_times <= shares[s].max_repeats and max(times.values()) - min(times.values()) <= 1
        blocks = [[r.doc_id for r in sorted(mine, key=lambda r: r.position) if r.block == b] for b in sorted({r.block for r in mine})]
        places = [sorted(r.position for r in mine if r.block == b) for b in sorted({r.block for r in mine})]
        assert all(p == list(range(len(p))) for p in places) and all(len(set(b)) == len(b) for b in blocks)
        if s == "small":  # whole passes, each in an order of its own, then the part that is left
            assert len(blocks) > 2 and all(len(b) == 30 for b in blocks[:-1]) and len({tuple(b) for b in blocks[:-1]}) == len(blocks) - 1
    half = {r.source_name: r for r in mixing.mix(d, cat, evenness=0.5)[1].collect()}
    assert 0 < half["small"].exponent < 1 and 0.1 < half["small"].share < 0.33 and half["small"].most_times <= 4
    none, empty = mixing.mix(d.where("doc_id < 0"), cat)
    assert none.count() == 0 and {r.mixed_tokens for r in empty.collect()} == {0}


def test_plan():
    sizes, goal, most = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    w, total, t = mixing.plan(sizes, goal, most, wanted=400)
    assert (w["a"], total, t) == (0.5, 400, 1.0)
    w, total, t = mixing.plan(sizes, goal, most, wanted=900)
    assert total == 900 and 0 < t < 1 and w["b"] * total <= 200 + 1e-6 and w["b"] * total > 199
    # without a size the mixture is no smaller than its sources
    w, total, t = mixing.plan({"a": 1000, "b": 10}, goal, {"a": 2, "b": 2})
    assert total == pytest.approx(1010) and 0 < t < 1 and w["b"] * total == pytest.approx(20)
    w, total, t = mixing.plan({"a": 500, "b": 600}, goal, {"a": 3, "b": 2})
    assert (t, total) == (1.0, 2400)
    assert mixing.plan({"a": 10, "b": 10}, goal, {"a": 1, "b": 1}, wanted=900)[1] == 20
    assert mixing.plan({"a": 0}, {"a": 0.0}, {"a": 1})[1] == 0
    for sizes, goal in (({"a": 900, "b": 100}, {"a": 0.5, "b": 0.5}), ({"a": 500, "b": 500}, {"a": 0.99, "b": 0.01})):
        w, _, t = mixing.plan(sizes, goal, {"a": 9, "b": 9}, evenness=0.5)
        n = mixing.entropy({s: x / 1000 for s, x in sizes.items()})
        assert 0 < t < 1 and mixing.entropy(w) == pytest.approx((n + mixing.entropy(goal)) / 2)
    assert mixing.entropy({"a": 0.5, "b": 0.5}) > mixing.entropy({"a": 0.9, "b": 0.1})
