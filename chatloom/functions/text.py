"""Names, bodies and rendered lines of messages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing date or author.
UNKNOWN = "unknown"
UNKNOWN_AUTHOR = "Unknown"
#: Texts of service messages, in the order in which they are tried.
ADDED, LEFT, RETITLED = "added to chat: ", "left chat: ", "changed chat title to: "
PHOTO_REMOVED, PHOTO_CHANGED, CREATED, PINNED = "removed chat photo", "changed chat photo", "created chat", "pinned a message"


def filled(value: Column) -> Column:
    """The string, with the empty one read as missing."""
    return F.when(value != "", value)


def display_name(user: Column) -> Column:
    """First and last name, else the user name, else the id."""
    full = F.concat_ws(" ", filled(user["first_name"]), filled(user["last_name"]))
    return F.coalesce(filled(full), filled(user["username"]), user["id"].cast("string"))


def author_label(from_user: Column, sender_chat: Column) -> Column:
    """The author's name; a present ``from_user`` is never overridden by the chat."""
    chat = F.coalesce(filled(sender_chat["title"]), filled(sender_chat["username"]), sender_chat["id"].cast("string"))
    return (
        F.when(from_user.isNotNull(), F.coalesce(display_name(from_user), F.lit("None")))
        .when(sender_chat.isNotNull(), F.coalesce(chat, F.lit("None")))
        .otherwise(F.lit(UNKNOWN_AUTHOR))
    )


def payload(text: Column, caption: Column) -> Column:
    """The text if it is not empty, else the caption if it is not empty, else null."""
    return F.coalesce(filled(text), filled(caption))


def event_text(m) -> Column:
    """The line that describes a service message; the first case that applies wins."""
    members = F.array_join(F.transform(m["new_chat_members"], display_name), ", ")
    created = (
        F.coalesce(m["group_chat_created"], F.lit(False))
        | F.coalesce(m["supergroup_chat_created"], F.lit(False))
        | F.coalesce(m["channel_chat_created"], F.lit(False))
    )
    return (
        F.when(F.size(m["new_chat_members"]) > 0, F.concat(F.lit(ADDED), members))
        .when(m["left_chat_member"].isNotNull(), F.concat(F.lit(LEFT), display_name(m["left_chat_member"])))
        .when(filled(m["new_chat_title"]).isNotNull(), F.concat(F.lit(RETITLED), m["new_chat_title"]))
        .when(F.coalesce(m["delete_chat_photo"], F.lit(False)), F.lit(PHOTO_REMOVED))
        .when(m["new_chat_photo"].isNotNull(), F.lit(PHOTO_CHANGED))
        .when(created, F.lit(CREATED))
        .when(m["pinned_message"].isNotNull(), F.lit(PINNED))
    )


def body(m) -> Column:
    """Payload, else event text, else null."""
    return F.coalesce(payload(m["text"], m["caption"]), event_text(m))


def timestamp_text(date: Column) -> Column:
    """Seconds precision, no zone conversion; null becomes ``unknown``."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit(UNKNOWN))


def week_bucket(date: Column) -> Column:
    """``YYYY-MM-wN`` with N counting weeks of the month from day 1 (w1 to w5); null becomes ``unknown``."""
    week = (F.floor((F.dayofmonth(date) - 1) / 7) + 1).cast("string")
    return F.coalesce(F.concat(F.date_format(date, "yyyy-MM"), F.lit("-w"), week), F.lit(UNKNOWN))


def text_record(m) -> Column:
    """One rendered message, null if it has no body."""
    return F.concat(
        F.lit("["), timestamp_text(m["date"]), F.lit("] "),
        author_label(m["from_user"], m["sender_chat"]), F.lit(": "), body(m), F.lit("\n\n"),
    )


def export_path(thread_id: Column, date: Column, suffix: str) -> Column:
    """``[thread/]bucket + suffix``; thread 0 is a thread, only null has no directory."""
    return F.concat_ws("/", thread_id.cast("string"), F.concat(week_bucket(date), F.lit(suffix)))


#: Letters and marks that leave no ink, beside white space, control and format characters.
BLANKS = r"\u115F\u1160\u3164\uFFA0\u2800\u034F\uFE00-\uFE0F"


def has_visible(value: Column) -> Column:
    """True if the string has a character that leaves ink; null has none."""
    return F.coalesce(value.rlike(rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}{BLANKS}]"), F.lit(False))
