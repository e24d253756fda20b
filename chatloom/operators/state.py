"""Per-chat progress state: reading, validating, merging and summarising it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import filled
from chatloom.operators.blocks import running
from chatloom.schemas import CHAT_TYPES, CHATS

#: Arrivals in one block of a running mark.
ARRIVALS = 1 << 16

FIELDS = (
    "id", "chat_type", "username", "qualname", "history_complete", "oldest_message_id", "latest_message_id",
)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def validate_state(records: DataFrame, record: str = "record") -> DataFrame:
    """Typed state rows of JSON objects; a row with any field of a wrong type is dropped.

    ``id`` must be whole (``true`` counts as a number), ``chat_type`` and ``qualname`` strings, ``username`` a string or
    null, the two marks whole or null, ``history_complete`` boolean; if that is absent it is false, an explicit null
    drops the row. Text that does not parse and values that are no objects are dropped.
    """
    whole = ("BIGINT", "BOOLEAN")
    v = F.try_parse_json(F.col(record))
    parsed = records.select(v.alias("v")).where(F.col("v").isNotNull())
    at = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "variant")
    parsed = parsed.where(_kind(F.col("v")).startswith("OBJECT")).select("v", *(at(x).alias(x) for x in FIELDS))
    kind = {x: F.coalesce(_kind(F.col(x)), F.lit("ABSENT")) for x in FIELDS}
    nothing = ("VOID", "ABSENT")
    ok = (
        kind["id"].isin(*whole)
        & kind["chat_type"].isin("STRING") & kind["qualname"].isin("STRING")
        & kind["username"].isin("STRING", *nothing)
        & kind["history_complete"].isin("BOOLEAN", "ABSENT")
        & kind["oldest_message_id"].isin(*whole, *nothing)
        & kind["latest_message_id"].isin(*whole, *nothing)
    )
    number = lambda x: F.try_variant_get(F.col(x), "$", "bigint")
    word = lambda x: F.try_variant_get(F.col(x), "$", "string")
    return parsed.where(ok).select(
        number("id").alias("id"), word("chat_type").alias("chat_type"), word("username").alias("username"),
        word("qualname").alias("qualname"),
        F.coalesce(F.try_variant_get(F.col("history_complete"), "$", "boolean"), F.lit(False)).alias("history_complete"),
        number("oldest_message_id").alias("oldest_message_id"), number("latest_message_id").alias("latest_message_id"),
    )


def type_name(value: Column) -> Column:
    """``ChatType.BOT`` and ``BOT`` are the same type."""
    return F.substring_index(value, ".", -1)


def chat_brief(chats: DataFrame) -> DataFrame:
    """Type, user name and display name of each dialog; the name may be null."""
    last = filled(F.col("last_name"))
    private = F.when(last.isNotNull(), F.concat(F.coalesce(F.col("first_name"), F.lit("None")), F.lit(" "), last)).otherwise(F.col("first_name"))
    kind = type_name(F.col("type"))
    name = (
        F.when(kind == "BOT", F.col("first_name"))
        .when(kind == "PRIVATE", private)
        .when(kind.isin("CHANNEL", "GROUP", "SUPERGROUP"), F.col("title"))
        .otherwise(F.lit("unknown"))
    )
    return chats.select(F.col("id"), kind.alias("chat_type"), F.col("username"), name.alias("qualname"))


def current_state(state: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The row with the highest ``ord`` of each chat; rows of a chat are combined before the shuffle."""
    rest = [c for c in state.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ord_col).isNotNull(), F.col(ord_col), F.to_json(F.struct(*rest))))
    return state.groupBy("id").agg(best.alias("_s")).select("id", *(F.col(f"_s.{c}").alias(c) for c in rest))


def merge_state(chats: DataFrame, saved: DataFrame, keep_vanished: bool = False) -> DataFrame:
    """Dialogs joined with saved progress: descriptions from the dialog, marks from the state.

    New dialogs start fresh. Chats that are no longer listed are left out unless ``keep_vanished``.
    """
    progress = saved.select("id", "history_complete", "oldest_message_id", "latest_message_id")
    merged = chat_brief(chats).join(progress, "id", "left").withColumn(
        "history_complete", F.coalesce("history_complete", F.lit(False))
    )
    if keep_vanished:
        gone = saved.join(chats.select("id"), "id", "left_anti").select(*merged.columns)
        merged = merged.unionByName(gone)
    return merged


def one_row_each(chats: DataFrame) -> DataFrame:
    """One row per dialog; of several rows of an id the least counts."""
    rest = [c for c in chats.columns if c != "id"]
    return chats.groupBy("id").agg(F.min(F.struct(*rest)).alias("_c")).select("id", *(F.col("_c").getField(c).alias(c) for c in rest))


def unnamed(ids: DataFrame) -> DataFrame:
    """Dialog rows of chats of which nothing but the id is known."""
    return ids.select("id", *(F.lit(None).cast("string").alias(c) for c in CHATS.names if c != "id"))


def ensure_chats(state: DataFrame, seen: DataFrame) -> DataFrame:
    """State plus a fresh row for each seen chat that it lacks; of several rows of a chat the least counts."""
    fresh = chat_brief(one_row_each(seen)).join(state.select("id"), "id", "left_anti")
    extra = [F.lit(False).alias("history_complete")] + [
        F.lit(None).cast("long").alias(x) for x in ("oldest_message_id", "latest_message_id")
    ]
    return state.select(*FIELDS).unionByName(fresh.select("*", *extra))


def dense_type_counts(chats: DataFrame) -> DataFrame:
    """Chats per type, with a row for each known type even if none has it."""
    domain = chats.sparkSession.createDataFrame([(t,) for t in CHAT_TYPES], "chat_type string")
    counted = chats.groupBy(type_name(F.col("type")).alias("chat_type")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counted, "chat_type", "left").select("chat_type", F.coalesce("n", F.lit(0)).cast("long").alias("n_chats"))


def progress_of(messages: DataFrame) -> DataFrame:
    """Lowest and highest id and the number of rows of each chat."""
    return messages.groupBy("chat_id").agg(
        F.min("id").alias("oldest_message_id"), F.max("id").alias("latest_message_id"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def chat_mapping(state: DataFrame) -> DataFrame:
    """Id to name, the last row of an id winning (the form of the JSON export)."""
    return current_state(state).select("id", "qualname")


def chat_mapping_lines(state: DataFrame) -> DataFrame:
    """``id<TAB>name`` lines, duplicates kept (the form of the text export)."""
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), F.coalesce("qualname", F.lit("None")))
    return state.select(F.col("ord"), line.alias("line"))


def running_marks(messages: DataFrame) -> DataFrame:
    """Lowest and highest id so far after each arrival of a chat."""
    rows = messages.select("chat_id", "id", "arrival_seq", F.floor(F.col("arrival_seq") / ARRIVALS).alias("_block"))
    for kind, name in (("min", "oldest_message_id"), ("max", "latest_message_id")):
        rows = running(rows, ("chat_id",), "_block", ("arrival_seq",), kind, F.col("id"), name)
    return rows.drop("_block")
