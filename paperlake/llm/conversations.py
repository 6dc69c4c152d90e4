"""Conversations rebuilt from message rows, and the faulty ones found.

Messages are keyed by conversation, sorted by time and run through a
finite-state automaton over the two kinds that count, user turns and answers.
Everything that needs no order (blank or unreadable messages, missing times)
is one aggregation per conversation. For the order, messages of one
conversation and time are first reduced to counts, then split into blocks of
consecutive times; the automaton runs inside each block and once more over
the blocks' first and last symbols. No conversation, however long, is
gathered in one task.

Defined results: copies (same ``id``) count once, the earliest loaded one (of
equally early ones the least row, null times last); null ids are no copies of
each other, and such messages are turns like any other, after those with an
id at equal times; messages of a null or unknown
conversation belong to none; a conversation without messages is ``empty``.
Equal times put system before user before assistant, then the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of the three speakers, compared in lower case without other characters.
USER_ROLES = ["user", "usr", "human", "person", "customer", "client", "enduser", "visitor", "me", "you", "u"]
ASSISTANT_ROLES = ["assistant", "asst", "ai", "bot", "chatbot", "model", "agent", "gpt", "llm", "aiassistant", "a"]
SYSTEM_ROLES = ["system", "sys", "developer", "systemprompt", "s"]

# Characters that are invisible though no white space, control or format character.
INVISIBLE = "⠀ㅤᅟᅠﾠ͏"

# Whole answers that say nothing, without case and surrounding brackets or dots.
PLACEHOLDERS = (
    "n/?a|none|null|nil|nan|undefined|todo|tbd|placeholder|empty|blank|no (?:answer|response|reply|content|output)"
    "|empty (?:answer|response|reply|message)|(?:answer|response|reply) (?:missing|pending|unavailable)"
    "|loading|thinking|generating|pending|error|failed|failure|timeout"
)
# How an error notice begins; what follows may be anything without a second paragraph.
ERROR_STARTS = (
    "\\[(?:error|exception|failed|failure|timeout)\\]|(?:internal |server |fatal |api |network )*(?:error|exception) ?[:(\\[0-9]"
    "|traceback\\b|sorry, (?:something|an error|there was)|oops\\b|something went wrong|an (?:unexpected )?error (?:has )?occurred"
    "|(?:the )?request (?:failed|timed out|was (?:cancelled|aborted))|connection (?:reset|refused|closed|lost|timed out|error)"
    "|rate limit (?:reached|exceeded|hit)|too many requests|(?:generation|response|reply|stream|output) (?:was )?"
    "(?:interrupted|failed|aborted|cancelled|cut off|timed out)|(?:service|model|server) (?:is )?(?:currently )?(?:unavailable|overloaded|timed out)"
    "|upstream (?:model )?(?:error|timed out)|timed out (?:after|while)|failed to (?:generate|fetch|load|get|produce)|http(?: error)? [45][0-9][0-9]"
)
#: Blocks of a long conversation; each has about the same number of points.
BLOCKS = 64


def speaker(role: Column) -> Column:
    """``user``, ``assistant``, ``system`` or null for a role that names none of them."""
    r = F.regexp_replace(F.lower(role), "[^a-z]", "")
    return (
        F.when(r.isin(USER_ROLES), "user").when(r.isin(ASSISTANT_ROLES), "assistant").when(r.isin(SYSTEM_ROLES), "system")
    )


def blank(content: Column) -> Column:
    """True for null and for text of white space or invisible characters only."""
    return content.isNull() | content.rlike(f"^[\\s\\p{{Z}}\\p{{C}}{INVISIBLE}]*$")


def no_answer(content: Column) -> Column:
    """True for blank content, a placeholder or a mere error notice."""
    t = F.lower(F.regexp_replace(content, f"^[\\s\\p{{Z}}\\p{{C}}{INVISIBLE}]+|[\\s\\p{{Z}}\\p{{C}}{INVISIBLE}]+$", ""))
    hollow = t.rlike(f"^[\\p{{P}}\\p{{S}}]*(?:{PLACEHOLDERS})?[\\p{{P}}\\p{{S}}]*$")
    notice = ~t.contains("\n\n") & t.rlike(f"^(?:[^\\p{{L}}\\p{{N}}\\[]*)(?:{ERROR_STARTS})")
    return blank(content) | hollow | notice


def classified(messages: DataFrame, *more: str) -> DataFrame:
    """One row per message: id, conversation_id, ts, kind, loaded_at, and the columns ``more`` of the same copy.

    ``kind``: ``u`` user turn, ``b`` blank user turn, ``a`` answer, ``x``
    passed over, ``?`` no readable speaker.
    """
    who = speaker(F.col("role"))
    kind = (
        F.when(who.isNull(), "?")
        .when(who == "system", "x")
        .when(who == "user", F.when(blank(F.col("content")), "b").otherwise("u"))
        .otherwise(F.when(no_answer(F.col("content")), "x").otherwise("a"))
    )
    small = messages.where(F.col("conversation_id").isNotNull()).select(
        F.col("id"),
        F.col("loaded_at"),
        F.col("conversation_id"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts"),
        kind.alias("kind"),
        *more,
    )
    cols = ["loaded_at", "conversation_id", "ts", "kind", *more]
    one = (
        small.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct(F.col("loaded_at").isNull(), *cols)).alias("m"))
        .select("id", *[F.col(f"m.{c}").alias(c) for c in cols])
    )
    return one.unionByName(small.where(F.col("id").isNull()))


def _blocks(points: DataFrame, size: int) -> DataFrame:
    """``points`` (conversation_id, ts, ...) with ``block``: consecutive times.

    A conversation of more than ``size`` points is cut at BLOCKS quantiles of
    its times, so each block has about the same number of points however they
    crowd; equal times stay together.
    """
    long = points.groupBy("conversation_id").agg(F.count("*").alias("n")).where(F.col("n") > size).select(F.col("conversation_id").alias("_c"))
    # one sketch per long conversation, combined before the shuffle; at most one row per `size` points
    cuts = F.percentile_approx("ts", F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)]), 10 * BLOCKS)
    bounds = points.join(long, F.col("conversation_id") == F.col("_c")).groupBy("_c").agg(F.array_distinct(cuts).alias("bounds"))
    # the join is the optimizer's to plan, with the runtime skew split
    joined = points.join(bounds, F.col("conversation_id") == F.col("_c"), "left")
    block = F.size(F.filter("bounds", lambda b: b < F.col("ts")))
    return joined.withColumn("block", F.when(F.col("bounds").isNull(), 0).otherwise(block).cast("long")).drop("_c", "bounds")


def faults(conversations: DataFrame, messages: DataFrame, block: int = 20_000) -> DataFrame:
    """conversation_id, fault (``empty``, ``broken`` or ``no_reply``, the first that applies)."""
    is_kind = lambda *k: F.col("kind").isin(*k)
    points = classified(messages).groupBy("conversation_id", "ts").agg(
        F.count_if(is_kind("u", "b")).alias("u"),
        F.count_if(is_kind("a")).alias("a"),
        F.count_if(is_kind("u")).alias("said"),
        F.count_if(is_kind("b", "?") | F.col("ts").isNull()).alias("bad"),
    )
    flags = points.groupBy("conversation_id").agg(
        F.sum("said").alias("said"), F.sum("a").alias("answers"), F.sum("bad").alias("bad")
    )
    turns = points.where(F.col("ts").isNotNull() & (F.col("u") + F.col("a") > 0)).select("conversation_id", "ts", "u", "a")

    # Automaton: the state is the last symbol, U (awaiting an answer) or A. At one time users come first.
    first, last = F.when(F.col("u") > 0, "U").otherwise("A"), F.when(F.col("a") > 0, "A").otherwise("U")
    w = Window.partitionBy("conversation_id", "block").orderBy("ts")
    steps = (
        _blocks(turns, block)
        .withColumn("first", first)
        .withColumn("last", last)
        .withColumn("before", F.lag("last").over(w))
    )
    broken = (F.col("a") > 1) | ((F.col("first") == "A") & (F.col("before") == "A"))
    silent = (F.col("u") > 1) | ((F.col("first") == "U") & (F.col("before") == "U"))
    per_block = steps.groupBy("conversation_id", "block").agg(
        F.min_by("first", "ts").alias("first"),
        F.max_by("last", "ts").alias("last"),
        F.coalesce(F.max(broken), F.lit(False)).alias("broken"),
        F.coalesce(F.max(silent), F.lit(False)).alias("silent"),
    )
    v = Window.partitionBy("conversation_id").orderBy("block")
    joined = per_block.withColumn("before", F.lag("last").over(v))
    order = joined.groupBy("conversation_id").agg(
        F.max(F.col("broken") | ((F.col("first") == "A") & F.coalesce(F.col("before") != "U", F.lit(True)))).alias("broken"),
        (
            F.max(F.col("silent") | ((F.col("first") == "U") & F.coalesce(F.col("before") == "U", F.lit(False))))
            | (F.max_by("last", "block") == "U")
        ).alias("silent"),
    )

    known = conversations.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct()
    all_ = known.join(flags, "conversation_id", "left").join(order, "conversation_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    fault = (
        F.when((zero("said") == 0) & (zero("answers") == 0), "empty")
        .when((zero("bad") > 0) | no("broken"), "broken")
        .when(no("silent"), "no_reply")
    )
    return all_.select("conversation_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def rebuilt(conversations: DataFrame, messages: DataFrame, block: int = 20_000) -> DataFrame:
    """The turns of the sound conversations: conversation_id, turn, speaker, ts, content.

    ``turn`` counts from 1 over user turns and answers. It is the number
    inside the block plus the sizes of the blocks before, so no task sees a
    whole long conversation.
    """
    bad = faults(conversations, messages, block).select("conversation_id")
    good = conversations.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct()
    good = good.join(bad, "conversation_id", "left_anti")
    kept = classified(messages, "content").where(F.col("kind").isin("u", "a")).join(good, "conversation_id", "left_semi")
    placed = _blocks(kept.select("conversation_id", "ts", "kind", "id", "content"), block)
    w = Window.partitionBy("conversation_id", "block").orderBy("ts", F.col("kind").desc(), F.col("id").asc_nulls_last(), "content")
    v = Window.partitionBy("conversation_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conversation_id", "block").agg(F.count("*").alias("n"))
    start = sizes.select("conversation_id", "block", F.coalesce(F.sum("n").over(v), F.lit(0)).alias("start"))
    return placed.withColumn("k", F.row_number().over(w)).join(start, ["conversation_id", "block"]).select(
        "conversation_id",
        (F.col("start") + F.col("k")).alias("turn"),
        F.when(F.col("kind") == "u", "user").otherwise("assistant").alias("speaker"),
        "ts",
        "content",
    )
