"""Orphan references against small tables, and the registry."""

import datetime as dt

from paperlake.operators import references as R

T = dt.datetime(2024, 1, 10)
D = dt.timedelta(days=1)


def graph(spark, conv, msg, sess, kbs):
    c = spark.createDataFrame(conv, "id string, session_id string, kb_name string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz, _state string")
    m = spark.createDataFrame(msg, "id string, conversation_id string, timestamp timestamp_ntz, loaded_at timestamp_ntz, title string")
    s = spark.createDataFrame(sess, "id string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz")
    k = spark.createDataFrame(kbs, "name string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz")
    return R.chat_graph(m, c, s, k)


def test_states(spark):
    sess = [("s1", T, None, T), ("s2", T, T, T), ("s3", T, None, T + 5 * D), ("s4", T, None, T), ("s4", T, T - D, T - D), (None, T, None, T)]
    conv = [
        ("c1", "s1", None, T, None, T, "x"), ("c1", "s1", None, T, None, T + D, "x"), ("c2", "nope", None, T, None, T, "x"), ("c3", "s2", None, T, None, T, "x"),
        ("c4", "s3", "", T, None, T, "x"), ("c5", "s4", "k", None, None, T, "x"), (None, "nope", None, T, None, T, "x"),
    ]
    msg = [("m1", "c1", T, T, ""), ("m2", "c2", T, T, ""), ("m3", "zz", None, T, ""), ("m4", None, T, T, ""), ("m5", "c4", T, T, "")]
    g = graph(spark, conv, msg, sess, [("k", T, None, T)])
    got = {(r.child_table, r.fk_field, r.row_id): r.state for r in R.direct(g).collect()}
    assert got == {
        ("conversations", "session_id", "c2"): "missing", ("conversations", "session_id", "c3"): "deleted", ("conversations", "session_id", "c4"): "late",
        ("conversations", "kb_name", "c4"): "missing", ("messages", "conversation_id", "m3"): "missing",
    }
    rows = {(r.row_id, r.kind, r.depth) for r in R.cascade(g).where("child_table = 'messages'").collect()}
    assert rows == {("m3", "direct", 0), ("m2", "inherited", 1), ("m5", "inherited", 1)}


def test_empty(spark):
    g = graph(spark, [], [("m", "c", T, T, "")], [], [])
    assert [r.state for r in R.direct(g).collect()] == ["missing"]
    assert R.report(R.cascade(graph(spark, [], [], [], []))).count() == 0


def test_cycle(spark):
    rows = [("a", "gone"), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")]
    t = spark.createDataFrame([(i, p, T, T) for i, p in rows], "id string, parent string, at timestamp_ntz, loaded_at timestamp_ntz")
    g = R.Graph({"t": R.Table(t, "id", "at")}, [R.Reference("t", "parent", "t")])
    assert sorted((r.row_id, r.kind, r.depth) for r in R.cascade(g).collect()) == [("a", "direct", 0), ("b", "inherited", 1), ("c", "inherited", 2)]


def test_hot_key(spark):
    msg = [(f"m{i}", "hot" if i % 3 else f"c{i}", T, T, "") for i in range(300)]
    g = graph(spark, [("hot", None, None, T, T - D, T, "")], msg, [], [])
    g.hot = lambda ref: ["hot"]
    got = {r.row_id: r.state for r in R.direct(g).collect()}
    assert sum(v == "deleted" for v in got.values()) == 200 and sum(v == "missing" for v in got.values()) == 100


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p4_found", "bm25_topk"} <= set(entry.queries())
