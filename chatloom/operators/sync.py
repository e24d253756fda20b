"""Backfill, catch-up and live acceptance of messages against per-chat marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.blocks import running

#: Arrivals in one block of a running mark, and ids in one block of a numbering.
ARRIVALS = 1 << 16
ID_BLOCK = 1 << 14


def _above() -> Column:
    return F.col("id") > F.col("_high")


def _below() -> Column:
    return (F.col("_low") == 0) | (F.col("id") < F.col("_low"))


def _low() -> Column:
    return F.coalesce("oldest_message_id", F.lit(0)).alias("_low")


def _judged(messages: DataFrame, marks: DataFrame, kept: Column) -> DataFrame:
    """Messages that the marks of their chat keep.

    A semi-join never broadcasts its left side. An inner join may: keys of wide messages are estimated at a hundredth of
    the file, as sizes go by the widths of columns, and all of them would pass through the driver.
    """
    return messages.join(marks, (F.col("chat_id") == F.col("_chat")) & kept, "left_semi")


def tail(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages above their chat's highest known id; a chat without a mark has no tail."""
    marks = state.select(F.col("id").alias("_chat"), F.col("latest_message_id").alias("_high")).where("_high is not null")
    return _judged(messages, marks, _above())


def backfill(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages below the lowest known id of chats whose history is incomplete; mark 0 or null means from the newest."""
    marks = state.where(~F.coalesce("history_complete", F.lit(False))).select(F.col("id").alias("_chat"), _low())
    return _judged(messages, marks, _below())


def numbered_batches(messages: DataFrame, batch_size: int) -> DataFrame:
    """Adds ``batch_no`` (from 0): chunks of ``batch_size`` rows of a chat from the highest id down."""
    # Blocks of neighbouring ids, the highest first and rows without an id last; a block is at most a task's.
    block = F.coalesce(F.floor(-F.col("id") / ID_BLOCK), F.lit((1 << 62)))
    placed = running(messages.withColumn("_block", block), ("chat_id",), "_block", (F.desc("id"), F.asc("arrival_seq")), "sum", F.lit(1), "_place")
    return placed.withColumn("batch_no", F.floor((F.col("_place") - 1) / batch_size).cast("long")).drop("_block", "_place")


def batch_summary(messages: DataFrame, batch_size: int) -> DataFrame:
    """Rows, marks and the running counter of each chunk."""
    per = numbered_batches(messages, batch_size).groupBy("chat_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("oldest_message_id"), F.max("id").alias("latest_message_id")
    )
    w = Window.partitionBy("chat_id").orderBy("batch_no")
    return per.withColumn("counter", F.sum("n_rows").over(w))


def pending(messages: DataFrame, state: DataFrame) -> DataFrame:
    """The tail in ascending order of ids, chat by chat; rows of one id in order of arrival."""
    return tail(messages, state).orderBy("chat_id", "id", "arrival_seq")


def live_accepted(messages: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Rows whose id is above every id of the chat that arrived before; others are late or repeated.

    ``marks`` (chat_id, mark) holds the highest id of each chat before these rows.
    """
    if marks is not None:
        known = messages.join(marks.select("chat_id", F.col("mark").alias("_mark")), "chat_id", "left")
        messages = known.where(F.col("_mark").isNull() | (F.col("id") > F.col("_mark"))).select(*messages.columns)
    blocked = messages.withColumn("_block", F.floor(F.col("arrival_seq") / ARRIVALS))
    seen = running(blocked, ("chat_id",), "_block", ("arrival_seq",), "max", F.col("id"), "_seen", current=False)
    return seen.where(F.col("_seen").isNull() | (F.col("id") > F.col("_seen"))).drop("_seen", "_block")


def _done(revive_empty: bool) -> Column:
    done = F.coalesce("history_complete", F.lit(False))
    return done & (F.col("latest_message_id").isNotNull() | F.col("oldest_message_id").isNotNull()) if revive_empty else done


def advance(messages: DataFrame, state: DataFrame, revive_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """One pass over all chats: (rows to export, the state after it).

    Complete chats give their tail, others their backfill. Afterwards every chat of the second kind is complete; its
    lowest mark is the lowest id read, its highest mark is set only where it was null. A chat found empty stays null and
    is not read again, unless ``revive_empty``.
    """
    done = _done(revive_empty)
    marks = state.select(F.col("id").alias("_chat"), done.alias("_done"), _low(), F.col("latest_message_id").alias("_high"))
    # One join for both kinds of chats, so that messages are moved once.
    rows = _judged(messages, marks, F.when(F.col("_done"), _above()).otherwise(_below()))
    read = rows.groupBy(F.col("chat_id").alias("id")).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    joined = state.join(read, "id", "left")
    after = joined.withColumns({
        "oldest_message_id": F.when(done, F.col("oldest_message_id")).otherwise(F.coalesce("_low", "oldest_message_id")),
        "latest_message_id": F.when(done, F.greatest("latest_message_id", "_high")).otherwise(F.coalesce("latest_message_id", "_high")),
        "history_complete": F.lit(True),
    }).drop("_low", "_high")
    return rows, after


def synchronise(messages: DataFrame, state: DataFrame, revive_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`advance` with the ``branch`` (tail or backfill) of each row."""
    rows, after = advance(messages, state, revive_empty)
    branch = F.when(_done(revive_empty), F.lit("tail")).otherwise(F.lit("backfill")).alias("branch")
    return rows.join(state.select(F.col("id").alias("chat_id"), branch), "chat_id", "left"), after
