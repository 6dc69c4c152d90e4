"""Faulty and rebuilt conversations against a plain automaton."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paperlake.llm import conversations as C

T = dt.datetime(2024, 1, 1)
M = "id string, conversation_id string, role string, content string, timestamp timestamp_ntz, loaded_at timestamp_ntz, fault string"
CONV = "id string, fault string, block int"


def plain(conv, msgs):
    """The rules written out for one small table."""
    first = {}
    for m in sorted(msgs, key=lambda m: m[5]):
        first.setdefault(m[0], m)
    out = {}
    for c in {c for c, *_ in conv if c}:
        rows = [m for m in first.values() if m[1] == c]
        kind = lambda m: {"user": "u", "assistant": "a", "system": "s"}.get(m[2], "?")
        answer = lambda m: kind(m) == "a" and (m[3] or "").strip() and m[3] != "N/A"
        said = [m for m in rows if answer(m) or (kind(m) == "u" and (m[3] or "").strip())]
        if not said:
            out[c] = "empty"
            continue
        bad = any(m[4] is None or kind(m) == "?" or (kind(m) == "u" and not (m[3] or "").strip()) for m in rows)
        seq = sorted((m for m in rows if m[4] and (answer(m) or kind(m) == "u")), key=lambda m: (m[4], kind(m) == "a"))
        s = ["u" if kind(m) == "u" else "a" for m in seq]
        bad = bad or any(x == "a" and (i == 0 or s[i - 1] != "u") for i, x in enumerate(s))
        if bad:
            out[c] = "broken"
        elif any(x == "u" and (i + 1 == len(s) or s[i + 1] != "a") for i, x in enumerate(s)):
            out[c] = "no_reply"
    return out


def test_random(spark):
    rnd = random.Random(5)
    conv = [(f"c{i}", None, 1) for i in range(60)] + [("c1", "x", 2), ("none", None, 3), (None, None, None)]
    msgs = []
    for i in range(400):
        role = rnd.choice(["user", "assistant"] * 8 + ["system", "??"] * (i % 40 == 0))
        text = rnd.choice(["hi"] * 20 + ["N/A", " ​", None] * (i % 5 == 0))
        at = T + dt.timedelta(minutes=rnd.randrange(12)) if i % 60 else None
        msgs.append((f"m{i}", f"c{rnd.randrange(60)}", role, text, at, T + dt.timedelta(days=i), ""))
    for c in range(40, 60):  # sound ones
        msgs = [m for m in msgs if m[1] != f"c{c}"]
        for k in range(6):
            msgs.append((f"s{c}-{k}", f"c{c}", "user" if k % 2 == 0 else "assistant", "hi", T + dt.timedelta(minutes=k // 2), T, ""))
    msgs += [(m[0], m[1], m[2], m[3], m[4], m[5] + dt.timedelta(days=900), "") for m in msgs[::7]] + [("x", None, "user", "hi", T, T, "")]
    d, c = spark.createDataFrame(msgs, M), spark.createDataFrame(conv, CONV)
    want = plain(conv, msgs)
    assert want and len(set(want.values())) == 3
    for block in (1, 2, 20_000):
        assert {r.conversation_id: r.fault for r in C.faults(c, d, block).collect()} == want
    turns = C.rebuilt(c, d, 2).collect()
    good = {r.conversation_id for r in turns}
    assert good == {f"c{i}" for i in range(60)} - set(want)
    one = sorted((r.turn, r.speaker) for r in turns if r.conversation_id == min(good))
    assert [t for t, _ in one] == list(range(1, len(one) + 1)) and {s for _, s in one[::2]} == {"user"} and {s for _, s in one[1::2]} == {"assistant"}


def test_words(spark):
    rows = [
        ("Human", "user"), (" AI ", "assistant"), ("SYSTEM", "system"), ("bot", "assistant"), ("???", None), ("0", None), (None, None), ("n/a", None)
    ]
    df = spark.createDataFrame(rows, "r string, w string")
    assert all(x.w == x.g for x in df.select("w", C.speaker(F.col("r")).alias("g")).collect())
    no = ["[error] upstream model timed out", "Traceback: call 3 failed", "N/A", "(no answer)", "null", "...", "⚠️ generation interrupted", "<empty response>",
          "Connection reset before a reply was produced (code 2)", "Request failed with status 500", "Rate limit reached, retry in 3 s", "[placeholder]",
          "Sorry, something went wrong. Please try again.", "Error: request timed out after 90 s", "", "​", "\xa0\xa0", "\n", None]
    yes = ["Error bars show the standard deviation. Models fit.", "None of the cells grew.", "Failed trials were repeated twice.", "42", "Rate limits of growth vary."]
    got = spark.createDataFrame([(t, True) for t in no] + [(t, False) for t in yes], "t string, w boolean")
    assert [r.t for r in got.select("t", "w", C.no_answer(F.col("t")).alias("g")).collect() if r.w != r.g] == []


def test_empty(spark):
    none_m, none_c = spark.createDataFrame([], M), spark.createDataFrame([], CONV)
    one = spark.createDataFrame([("c", "x", 1)], CONV)
    assert [tuple(r) for r in C.faults(one, none_m).collect()] == [("c", "empty")]
    assert C.faults(none_c, none_m).count() == 0 and C.rebuilt(one, none_m).count() == 0


def test_turns_without_id_or_load_time(spark):
    """No turn hangs on a key or time of delivery that may be null."""
    at = lambda k: T + dt.timedelta(minutes=k)
    msgs = [(None, "c", "user", "one", at(0), T, ""), ("b", "c", "assistant", "two", at(1), None, ""), (None, "c", "user", "three", at(2), None, ""),
            ("d", "c", "assistant", "four", at(3), T, ""), ("d", "c", "assistant", "later", at(3), at(9), "")]
    d, c = spark.createDataFrame(msgs, M), spark.createDataFrame([("c", None, 1)], CONV)
    for block in (1, 20_000):
        got = sorted((r.turn, r.speaker, r.content) for r in C.rebuilt(c, d, block).collect())
        assert got == [(1, "user", "one"), (2, "assistant", "two"), (3, "user", "three"), (4, "assistant", "four")]


def test_blocks_follow_the_points(spark):
    """Times that crowd one moment are cut as evenly as others; every block is a range of times."""
    rows = [("hot", i if i < 9_000 else 10**12 + i * 10**9) for i in range(10_000)] + [("cold", i) for i in range(50)]
    got = C._blocks(spark.createDataFrame(rows, "conversation_id string, ts long"), 100).groupBy("conversation_id", "block").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    ).collect()
    hot = sorted((r.block, r.lo, r.hi, r.n) for r in got if r.conversation_id == "hot")
    assert len(hot) > 50 and max(n for *_, n in hot) < 3 * 10_000 / C.BLOCKS and all(a[2] < b[1] for a, b in zip(hot, hot[1:]))
    assert len(got) - len(hot) == 1
