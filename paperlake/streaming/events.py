"""Answer streams as event rows, their collection, and incremental ingest of papers.

An event is (session, seq, event, data); ``data`` is JSON with answer text in
Base64, as it crosses the wire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.operators.chunking import pieces
from paperlake.operators.store import first_seen

# Kinds of events in their usual order.
KINDS = ["status", "thinking", "tool_call", "tool_result", "source", "content", "evidence_update", "papers_found", "done", "error"]


def wire(x: Column) -> Column:
    return F.base64(F.encode(x, "utf-8"))


def unwire(x: Column) -> Column:
    return F.decode(F.unbase64(x), "utf-8")


def answer_events(answers: DataFrame, session: str, text: str, chars: int = 100) -> DataFrame:
    """session, seq, event, data: content events of ``chars`` characters, then ``done``. Null answers give ``done`` only."""
    parts = pieces(answers, session, text, chars).select(
        session, "seq", F.lit("content").alias("event"), F.to_json(F.struct(wire(F.col("delta")).alias("delta"))).alias("data")
    )
    n = F.when(F.length(text) > 0, F.floor((F.length(text) - 1) / chars) + 1).otherwise(0)
    done = answers.select(session, n.cast("int").alias("seq"), F.lit("done").alias("event"), F.to_json(F.struct(n.alias("parts"))).alias("data"))
    return parts.unionByName(done)


def source_events(sources: DataFrame, session: str, order: str) -> DataFrame:
    """One ``source`` event for each row, its columns as JSON."""
    cols = [c for c in sources.columns if c not in (session, order)]
    return sources.select(session, F.col(order).alias("seq"), F.lit("source").alias("event"), F.to_json(F.struct(*cols)).alias("data"))


def collected(events: DataFrame, session: str = "session") -> DataFrame:
    """session, answer, finished, failed: content events of each session in order, decoded and joined.

    A session's events are one answer; they are joined as one row.
    """
    data = F.from_json("data", "delta string, content string")
    plain = F.coalesce(unwire(data["delta"]), data["content"], F.lit(""))
    part = F.when(F.col("event") == "content", F.struct("seq", plain.alias("t")))
    rows = events.groupBy(session).agg(
        F.array_sort(F.collect_list(part)).alias("p"), F.max(F.col("event") == "done").alias("finished"), F.max(F.col("event") == "error").alias("failed")
    )
    return rows.select(session, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("answer"), "finished", "failed")


def envelope(ok: Column, data: Column, error: Column | None = None) -> Column:
    """JSON of ``{"success": true, "data": …}`` or ``{"success": false, "error": …}``."""
    bad = F.to_json(F.struct(F.lit(False).alias("success"), (error if error is not None else F.lit("error")).alias("error")))
    return F.when(ok, F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))).otherwise(bad)


def ingest(papers: DataFrame, key: str, target: str, checkpoint: str, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Append papers of a stream whose key is not in ``target`` (Parquet) yet, the first of each key in a batch (``store.first_seen``).

    A batch that is repeated after a failure finds its rows in the target and
    adds none, so the table has each key once.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_seen(batch.where(F.col(key).isNotNull()), [key], order)
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    writer = papers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def per_window(events: DataFrame, at: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per key and event-time window of a stream or table; a stream drops rows later than ``late``."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )
