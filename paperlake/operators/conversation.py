"""Conversation windows under token and character budgets, token counts and prices.

Defined results: null content counts as empty; ties of time go to the smaller
id; a budget below the first message keeps none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.text import token_estimate

# Context limits and prices per thousand tokens (input, output) of models; others take the default.
LIMITS = {
    "claude-3-5-sonnet-20241022": 200000, "claude-3-5-haiku-20241022": 200000, "claude-3-opus-20240229": 200000,
    "claude-3-sonnet-20240229": 200000, "claude-3-haiku-20240307": 200000, "gpt-4o": 128000, "gpt-4o-mini": 128000,
    "gpt-4-turbo": 128000, "gpt-4": 8192, "gpt-3.5-turbo": 16385, "deepseek-chat": 64000, "deepseek-reasoner": 64000,
    "gemini-1.5-pro": 1000000, "gemini-1.5-flash": 1000000, "gemini-1.0-pro": 32000,
}
DEFAULT_LIMIT, DEFAULT_OUTPUT = 4096, 4096
PRICES = {
    "claude-3-5-sonnet-20241022": (0.003, 0.015), "claude-3-5-haiku-20241022": (0.001, 0.005), "claude-3-opus-20240229": (0.015, 0.075),
    "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4-turbo": (0.01, 0.03), "deepseek-chat": (0.00014, 0.00028),
}
DEFAULT_PRICE = (0.01, 0.03)


def _pick(x: Column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), F.lit(default))


def message_tokens(role: Column, content: Column) -> Column:
    """4 and the estimates of role and content."""
    return token_estimate(role) + token_estimate(content) + 4


def conversation_tokens(messages: DataFrame, conv: str) -> DataFrame:
    """conv, messages, tokens: the messages' tokens and 2."""
    return messages.groupBy(conv).agg(
        F.count("*").alias("messages"), (F.sum(message_tokens(F.col("role"), F.col("content"))) + 2).alias("tokens")
    )


def limit(model: Column) -> Column:
    return _pick(model, LIMITS, DEFAULT_LIMIT)


def available(model: Column, used: Column, wanted: Column | None = None) -> Column:
    return F.least(limit(model) - used, F.coalesce(wanted, F.lit(DEFAULT_OUTPUT)) if wanted is not None else F.lit(DEFAULT_OUTPUT))


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    dollars_in = _pick(model, {k: v[0] for k, v in PRICES.items()}, DEFAULT_PRICE[0])
    dollars_out = _pick(model, {k: v[1] for k, v in PRICES.items()}, DEFAULT_PRICE[1])
    return tokens_in / 1000 * dollars_in + tokens_out / 1000 * dollars_out


def within_budget(messages: DataFrame, conv: str, order: list[str], budget: int) -> DataFrame:
    """Messages kept under a token budget: all if they fit, else system messages and the latest others that fit.

    The latest messages are counted back until one does not fit; that one and
    all before it are dropped. The running sum is a sorted window per
    conversation, which spills; nothing is collected.
    """
    t = messages.withColumn("_t", message_tokens(F.col("role"), F.col("content"))).withColumn("_sys", F.coalesce(F.col("role") == "system", F.lit(False)))
    sums = t.groupBy(conv).agg(
        (F.sum("_t") + 2).alias("_all"), (F.coalesce(F.sum(F.when(F.col("_sys"), F.col("_t"))), F.lit(0)) + 2).alias("_fixed")
    )
    back = Window.partitionBy(conv, "_sys").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    # a list of one message counts 2 tokens more than the message
    run = t.withColumn("_run", F.sum(F.col("_t") + 2).over(back)).join(sums, conv)
    keep = (F.col("_all") <= budget) | F.col("_sys") | (F.col("_run") <= budget - F.col("_fixed"))
    return run.where(keep).drop("_t", "_sys", "_all", "_fixed", "_run")


def latest(messages: DataFrame, conv: str, order: list[str], most: int) -> DataFrame:
    """The ``most`` latest messages of each conversation."""
    w = Window.partitionBy(conv).orderBy(*[F.col(c).desc() for c in order])
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def recent(conversations: DataFrame, most: int, updated: str = "updated_at", key: str = "id") -> DataFrame:
    """The ``most`` conversations updated last, the latest first; those without a time last, ties by key."""
    return conversations.orderBy(F.col(updated).desc_nulls_last(), key).limit(most)


def opening(messages: DataFrame, conv: str, order: list[str], most: int) -> DataFrame:
    """The ``most`` earliest messages of each conversation."""
    w = Window.partitionBy(conv).orderBy(*order)
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def block(messages: DataFrame, conv: str, order: list[str], chars: int = 2000, most: int = 8) -> DataFrame:
    """conv, block: the last ``most`` messages as labelled lines in at most about ``chars`` characters.

    A message that does not fit is cut if more than 40 characters are left,
    else the block ends there.
    """
    last = latest(messages, conv, order, most)
    strip = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rows = last.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct(*order, strip(F.col("role")).alias("role"), strip(F.col("content")).alias("content")))).alias("m")
    )
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("total"), F.lit(False).alias("over"))

    def fold(a: Column, m: Column) -> Column:
        label = F.when(m["role"] == "user", "User: ").otherwise("Assistant: ")
        piece = F.concat(label, m["content"])
        fits = a["total"] + F.length(piece) <= chars
        left = chars - a["total"] - 20
        cut = F.concat(label, F.left(m["content"], left), F.lit("…"))
        line = F.when(fits, piece).when(left > 40, cut)
        skip = a["over"] | (m["content"] == "")
        return F.struct(
            F.when(skip | line.isNull(), a["lines"]).otherwise(F.array_append(a["lines"], line)).alias("lines"),
            F.when(skip | line.isNull(), a["total"]).otherwise(a["total"] + F.length(line) + 1).alias("total"),
            (a["over"] | (~skip & line.isNull())).alias("over"),
        )

    lines = F.aggregate("m", zero, fold, lambda a: a["lines"])
    text = F.when(F.size(lines) > 0, F.concat(F.lit("Recent conversation:\n"), F.array_join(lines, "\n\n"))).otherwise("")
    return rows.select(conv, text.alias("block"))


def assembled(conversations: DataFrame, messages: DataFrame, order: list[str]) -> DataFrame:
    """Messages of existing conversations with their place in them (``n`` from 1) and the conversation's title."""
    w = Window.partitionBy("conversation_id").orderBy(*order)
    return messages.join(conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id").withColumn(
        "n", F.row_number().over(w)
    )
