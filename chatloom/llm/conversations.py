"""Conversations rebuilt from message rows.

The rows of one channel key (chat, thread) form a conversation, together with the opening row whose id is the thread.
Its timestamps are sorted and split into numbered sessions at pauses above a calibrated limit. Roles are inferred from
the author: an account of the bot table is the assistant, any other account a user, no account the system. Each session
is summed up by its last question and its last answer, and a conversation is the sum of its sessions, as it is kept or
dropped whole. One without a reciprocal reply is dropped: its opening row is missing, no user row has a body, or no
assistant row with a body follows the last user row with a body. Kept rows are ordered by id.

The calibrated limit is an exact quantile, in whole minutes, of all pauses inside conversations, at least half an hour.
So rows of one half-hour slot of a conversation never part, and everything about time and replies is decided on one row
per slot: rows are summed up into slots before the shuffle, and any number of rows of one date, such as a default date,
costs one row per task.

Defined results: copies of a message count once, the one with the lowest ``arrival_seq`` (null last, then by content);
rows without ``chat_id`` or ``id`` are not counted; rows above the current mark of their chat are not counted; a chat
without a state row has no mark; null or blank bodies are no bodies; rows without a date have no session but count for
replies; an empty table gives no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import has_visible, payload
from chatloom.operators.blocks import running
from chatloom.operators.state import current_state
from chatloom.storage import written

#: Per cent of the pauses inside conversations that the calibrated limit leaves whole, and the least limit in seconds.
GAP_PERCENT = 95
LEAST_GAP_S = 1800
CONVERSATION = ("chat_id", "thread_id")
ID_BLOCK = 1 << 14


def _body() -> Column:
    text = payload(F.col("text"), F.col("caption"))
    return F.when(has_visible(text), text)


def _content() -> Column:
    """Tells copies of one message apart that share their place in the order of delivery."""
    return F.xxhash64("reply_to_top_message_id", "date", "from_user.id", _body())


def counted_messages(messages: DataFrame, state: DataFrame, bots: DataFrame) -> DataFrame:
    """First deliveries not above their chat's mark, with role and whether there is a body; bodies are not carried."""
    rows = messages.where("chat_id is not null and id is not null").select(
        "chat_id", "id", F.col("reply_to_top_message_id").alias("thread_id"), "arrival_seq", F.col("date").alias("at"),
        F.col("from_user").isNull().alias("no_author"), F.col("from_user.id").alias("author"),
        _body().isNotNull().alias("has_body"), _content().alias("content"),
    )
    rest = [c for c in rows.columns if c not in ("chat_id", "id")]
    rank = F.struct(F.col("arrival_seq").isNull(), F.col("arrival_seq"), F.col("content"))
    best = rows.groupBy("chat_id", "id").agg(F.min_by(F.struct(*rest), rank).alias("_m"))
    once = best.select("chat_id", "id", *(F.col("_m").getField(c).alias(c) for c in rest))
    marks = current_state(state.select("id", "latest_message_id", "ord")).select(
        F.col("id").alias("chat_id"), F.col("latest_message_id").alias("_mark")
    )
    known = bots.select(F.col("id").alias("author")).where("author is not null").distinct().withColumn("_bot", F.lit(True))
    limited = once.join(marks, "chat_id", "left").where(F.col("_mark").isNull() | (F.col("id") <= F.col("_mark")))
    named = limited.join(known, "author", "left")
    role = F.when(F.col("no_author"), F.lit("system")).when(F.col("_bot"), F.lit("assistant")).otherwise(F.lit("user"))
    return named.select("chat_id", "id", "thread_id", "at", "has_body", role.alias("role"), "arrival_seq", "content")


def with_bodies(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds the body of the delivery each row stands for; bodies take part in this one exchange only."""
    keys = ("chat_id", "id", "_seq", "content")
    sources = messages.where("chat_id is not null and id is not null").select(
        "chat_id", "id", F.coalesce("arrival_seq", F.lit(-1)).alias("_seq"), _content().alias("content"), _body().alias("body")
    ).where("body is not null")
    once = sources.groupBy(*keys).agg(F.max("body").alias("body"))
    return rows.withColumn("_seq", F.coalesce("arrival_seq", F.lit(-1))).join(once, [*keys], "left").drop("_seq", "arrival_seq", "content")


def conversation_rows(counted: DataFrame) -> DataFrame:
    """The rows of all conversations: replies, and the opening row if it is not among them; ``slot`` is its half hour."""
    keys = counted.where("thread_id is not null").select("chat_id", "thread_id").distinct()
    replies = counted.where("thread_id is not null")
    opening = counted.where(F.col("thread_id").isNull() | (F.col("thread_id") != F.col("id")))
    opening = opening.withColumn("thread_id", F.col("id")).join(keys, [*CONVERSATION], "left_semi")
    rows = replies.unionByName(opening.select(*replies.columns))
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    return rows.withColumn("_t", micros).withColumn("slot", F.floor(F.col("_t") / (LEAST_GAP_S * 1_000_000)))


def slots(rows: DataFrame) -> DataFrame:
    """One row per half hour of a conversation: first and last time, rows, last question and answer, opening row."""
    body = F.col("has_body")
    return rows.groupBy(*CONVERSATION, "slot").agg(
        F.min("_t").alias("first"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("n_rows"),
        F.max(F.when(body & (F.col("role") == "user"), F.col("id"))).alias("asked"),
        F.max(F.when(body & (F.col("role") == "assistant"), F.col("id"))).alias("answered"),
        F.max((F.col("id") == F.col("thread_id")).cast("int")).alias("opened"),
    )


def with_pauses(slotted: DataFrame) -> DataFrame:
    """Adds the microseconds since the slot before; the window of a conversation holds half hours, not messages."""
    before = F.lag("last").over(Window.partitionBy(*CONVERSATION).orderBy("slot"))
    return slotted.withColumn("pause", F.when(F.col("slot").isNotNull(), F.col("first") - before))


def calibrated_gap(paused: DataFrame) -> int:
    """Seconds above which a pause splits: the quantile of all pauses in whole minutes, at least the least limit.

    Pauses inside a slot are shorter than the least limit, so only their number matters; those between slots are counted
    by minute, which gives a table as long as the calendar.
    """
    minute = F.floor(F.col("pause") / 60_000_000)
    timed = paused.where("slot is not null")
    n_pauses, n_between = timed.agg(F.sum(F.col("n_rows") - F.col("pause").isNull().cast("int")), F.count("pause")).first()
    rank = (GAP_PERCENT * (n_pauses or 0) + 99) // 100 - ((n_pauses or 0) - n_between)
    if rank <= 0:
        return LEAST_GAP_S
    counts = timed.where("pause is not null").groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    reached = counts.withColumn("_upto", F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)))
    return max(LEAST_GAP_S, 60 * reached.where(F.col("_upto") >= rank).agg(F.min("minute")).first()[0])


def sessions(paused: DataFrame, gap_s: int) -> DataFrame:
    """Adds ``session`` to each slot, counted from 0 in the order of time; null for the rows without a time."""
    split = F.coalesce(F.col("pause") > gap_s * 1_000_000, F.lit(False)).cast("long")
    number = F.sum(split).over(Window.partitionBy(*CONVERSATION).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return paused.withColumn("session", F.when(F.col("slot").isNotNull(), number))


def verdicts(numbered: DataFrame) -> DataFrame:
    """One row per conversation, summed up over its sessions, with why it is dropped (``drop_reason`` null: kept)."""
    each = numbered.groupBy(*CONVERSATION, "session").agg(
        F.max("asked").alias("asked"), F.max("answered").alias("answered"), F.max("opened").alias("opened"), F.sum("n_rows").alias("n_rows")
    )
    whole = each.groupBy(*CONVERSATION).agg(
        F.max("asked").alias("_asked"), F.max("answered").alias("_answered"), F.max("opened").alias("_opened"),
        F.sum("n_rows").alias("n_rows"), F.count("session").alias("n_sessions"),
    )
    reason = (
        F.when(F.col("_opened") == 0, F.lit("no opening row"))
        .when(F.col("_asked").isNull(), F.lit("no user row"))
        .when(F.col("_answered").isNull() | (F.col("_answered") < F.col("_asked")), F.lit("unanswered"))
    )
    return whole.select(*CONVERSATION, "n_rows", "n_sessions", reason.alias("drop_reason"))


def turns(rows: DataFrame) -> DataFrame:
    """Adds ``turn``, counted from 0 in the order of ids; a block of ids holds at most as many rows as ids."""
    blocked = rows.withColumn("_block", F.floor(F.col("id") / ID_BLOCK))
    numbered = running(blocked, CONVERSATION, "_block", ("id",), "sum", F.lit(1), "turn")
    return numbered.withColumn("turn", F.col("turn") - 1).drop("_block")


def sessionized(messages: DataFrame, state: DataFrame, bots: DataFrame, keep_rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The one operator behind kept and dropped conversations: (rows, numbered slots, verdicts).

    What several steps read is written to the shared folder; ``keep_rows`` tells whether the rows will be read again.
    """
    counted = written(counted_messages(messages, state, bots), "counted")
    rows = conversation_rows(counted)
    rows = written(rows, "conversations") if keep_rows else rows
    paused = written(with_pauses(slots(rows)), "slots")
    numbered = sessions(paused, calibrated_gap(paused))
    return rows, numbered, verdicts(numbered)


def kept_rows(messages: DataFrame, state: DataFrame, bots: DataFrame) -> DataFrame:
    """The rows of kept conversations with their session, without bodies."""
    rows, numbered, verdict = sessionized(messages, state, bots)
    kept = numbered.join(verdict.where("drop_reason is null"), [*CONVERSATION], "left_semi")
    slot = lambda c: F.coalesce(c, F.lit(-(1 << 62))).alias("_slot")
    marked = kept.select(*CONVERSATION, slot(F.col("slot")), "session")
    placed = rows.select("*", slot(F.col("slot"))).join(marked, [*CONVERSATION, "_slot"])
    return placed.drop("_slot", "slot", "_t")


def rebuild(messages: DataFrame, state: DataFrame, bots: DataFrame) -> DataFrame:
    """All kept conversations, a row per message with turn, session, role and body."""
    return with_bodies(turns(written(kept_rows(messages, state, bots), "kept")), messages).drop("has_body")


def dropped(messages: DataFrame, state: DataFrame, bots: DataFrame) -> DataFrame:
    """The conversations that :func:`rebuild` leaves out, with the reason."""
    return sessionized(messages, state, bots, keep_rows=False)[2].where("drop_reason is not null")
