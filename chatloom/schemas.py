"""Explicit schemas of the datasets the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType()}


def struct(fields: str) -> T.StructType:
    """``"name type, ..."`` as a struct of nullable columns."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


USER = struct("id long, first_name string, last_name string, username string")
MEDIA = struct(
    "kind string, big_file_id string, file_id string, file_unique_id string, file_name string, "
    "file_size long, mime_type string, date time, set_name string, emoji string"
)
STATE = struct(
    "id long, chat_type string, username string, qualname string, history_complete boolean, "
    "oldest_message_id long, latest_message_id long"
)
CHATS = struct(
    "id long, type string, title string, username string, first_name string, last_name string"
)
TOPICS = struct("chat_id long, topic_id long, title string")
MANIFEST = struct("raw_file_id string, file_name string, file_size long, file_type string")
TEXT_RECORD = struct("path string, text string")

#: Media slots of a message, in the order of priority.
MEDIA_SLOTS = (
    "animation", "audio", "document", "new_chat_photo", "photo", "sticker", "video", "video_note", "voice",
)

#: The chat types a dialog list can hold.
CHAT_TYPES = ("PRIVATE", "BOT", "GROUP", "SUPERGROUP", "CHANNEL")

MESSAGES = T.StructType(
    struct(
        "id long, chat_id long, date time, reply_to_top_message_id long, text string, caption string"
    ).fields
    + [T.StructField("new_chat_members", T.ArrayType(USER)), T.StructField("left_chat_member", USER)]
    + struct(
        "new_chat_title string, delete_chat_photo boolean, group_chat_created boolean, "
        "supergroup_chat_created boolean, channel_chat_created boolean"
    ).fields
    + [T.StructField("pinned_message", struct("id long"))]
    + [T.StructField("from_user", USER)]
    + [T.StructField("sender_chat", struct("id long, title string, username string"))]
    + [T.StructField(slot, MEDIA) for slot in MEDIA_SLOTS]
    + struct("batch_id long, arrival_seq long").fields
)
