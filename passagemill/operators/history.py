"""Conversation history over messages ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TURNS = 10

# Fixed value: system line of a chat prompt.
SYSTEM_LINE = (
    "You are a helpful assistant that answers questions based on the provided context. "
    "If the context does not contain enough information to answer, say so."
)


def message_text(content: Column, parts: Column) -> Column:
    """Content if not empty, else the first text part, else the empty string."""
    first = F.get(F.filter(parts, lambda p: p["type"] == "text"), F.lit(0))["text"]
    return F.coalesce(F.nullif(content, F.lit("")), first, F.lit(""))


def pair_turns(messages: DataFrame) -> DataFrame:
    """User messages with the assistant reply that directly follows: ``conv_id, turn, user_text, assistant_text``.

    Both messages meet under the user's turn number, so one aggregation on
    ``(conv_id, turn)`` pairs them and a long conversation is spread over many keys.
    """
    opener = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    keyed = messages.select("conv_id", opener.alias("turn"), "role", "text").filter("turn is not null")
    text_of = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return (
        keyed.groupBy("conv_id", "turn")
        .agg(text_of("user").alias("user_text"), text_of("assistant").alias("assistant_text"))
        .filter("user_text is not null and assistant_text is not null")
    )


def last_turns(turns: DataFrame, n: int = DEFAULT_TURNS) -> DataFrame:
    """The newest n turns per conversation, ``age`` 1 being the newest.

    The rank filter limits every partition to n rows per conversation before the
    shuffle, so a conversation that holds much of the table stays cheap.
    """
    n = n if n > 0 else DEFAULT_TURNS
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(window)).filter(F.col("age") <= n)


def conversation(messages: DataFrame, conv_id: int) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id)


def clear(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("conv_id"), "conv_id", "left_anti")


def purge_idle(table: DataFrame, key: str, ts: str, threshold: str, now: Column | None = None) -> DataFrame:
    """Rows of keys used within ``threshold`` of ``now`` (default: the newest time in the table)."""
    last = table.groupBy(key).agg(F.max(ts).alias("_last"))
    clock = table.agg(F.max(ts)).scalar() if now is None else now
    idle = last.filter(F.col("_last") < clock - F.expr(f"interval {threshold}"))
    return table.join(idle.select(key), key, "left_anti")


def sessions(table: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Stretches of use without a pause longer than ``gap``: ``<key>, session, started, ended, n_rows``, numbered from 1.

    A key's rows meet in one task in order of time; with ``spark.sql.sessionWindow.merge.sessions.in.local.partition``
    every task first merges its own, which is worth it where keys have very many rows.
    """
    merged = table.filter(F.col(ts).isNotNull()).groupBy(key, F.session_window(ts, gap).alias("_window"))
    found = merged.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_rows"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("started"))
    return found.select(key, number.cast("bigint").alias("session"), "started", "ended", "n_rows")


def query_text(messages: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Per conversation the explicit query, else the last non-empty user message."""
    usable = (F.col("role") == "user") & (F.coalesce(F.col("text"), F.lit("")) != "")
    found = messages.groupBy("conv_id").agg(
        F.coalesce(F.max_by(F.when(usable, F.col("text")), F.when(usable, F.col("turn"))), F.lit("")).alias("query")
    )
    if explicit is None:
        return found
    asked = explicit.select("conv_id", F.nullif(F.col("query"), F.lit("")).alias("_asked"))
    return found.join(asked, "conv_id", "left").select("conv_id", F.coalesce("_asked", "query").alias("query"))


def prompt_rows(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt of each conversation as ordered rows ``(conv_id, section, position, role, text)``.

    Section 0 is the system line, 1 the earlier user and assistant messages without
    a trailing user message and without empty ones, 2 the context and question.
    """
    last = messages.groupBy("conv_id").agg(
        F.max("turn").alias("_last"), F.max_by("role", "turn").alias("_last_role")
    )
    asked = query_text(messages).join(contexts, "conv_id", "left")
    history = (
        messages.join(last, "conv_id")
        .filter(~((F.col("turn") == F.col("_last")) & (F.col("_last_role") == "user")))
        .filter(F.col("role").isin("user", "assistant") & (F.coalesce(F.col("text"), F.lit("")) != ""))
        .select("conv_id", F.lit(1).alias("section"), F.col("turn").alias("position"), "role", "text")
    )
    question = asked.select(
        "conv_id",
        F.lit(2).alias("section"),
        F.lit(0).cast("bigint").alias("position"),
        F.lit("user").alias("role"),
        F.concat(
            F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query")
        ).alias("text"),
    )
    system = asked.select(
        "conv_id",
        F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("position"),
        F.lit("system").alias("role"),
        F.lit(SYSTEM_LINE).alias("text"),
    )
    return system.unionByName(history).unionByName(question)
