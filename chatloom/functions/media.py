"""Media choice and file naming as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.text import filled
from chatloom.schemas import MEDIA_SLOTS

#: Extension by file type where the MIME type gives none.
DEFAULT_EXTENSIONS = {
    "PHOTO": ".jpg", "CHAT_PHOTO": ".jpg", "NEW_CHAT_PHOTO": ".jpg", "THUMBNAIL": ".jpg",
    "VIDEO": ".mp4", "ANIMATION": ".mp4", "VIDEO_NOTE": ".mp4",
    "VOICE": ".ogg", "STICKER": ".webp", "AUDIO": ".mp3",
}

#: Extensions of the MIME types that occur in archives.
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
    "video/mp4": ".mp4", "video/webm": ".webm", "video/quicktime": ".mov",
    "audio/mpeg": ".mp3", "audio/ogg": ".ogg", "audio/mp4": ".m4a", "audio/x-wav": ".wav",
    "application/pdf": ".pdf", "application/zip": ".zip", "text/plain": ".txt", "application/json": ".json",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null where the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def chosen_media(m, slots: tuple[str, ...] = MEDIA_SLOTS) -> Column:
    """The first filled media slot."""
    return F.coalesce(*(m[s] for s in slots))


def has_media(m, slots: tuple[str, ...] = MEDIA_SLOTS) -> Column:
    """True if a slot is filled; a filled slot has a kind, so the scan reads no other field."""
    return reduce(lambda a, b: a | b, [m[s]["kind"].isNotNull() for s in slots])


def raw_file_id(media: Column) -> Column:
    return F.coalesce(media["big_file_id"], media["file_id"])


def media_file_name(media: Column, now: Column | None = None) -> Column:
    """Name under which a medium is listed.

    A missing name is made of type, date (``now`` if it has none) and an extension by MIME type or file type; stickers
    are always named by set and emoji; at last the unique id goes before the last dot. A name without a dot gets the
    extension ``unknown``. As the extensions bring their own dot, a generated name holds two.
    """
    kind = F.lower(media["kind"])
    now = F.current_timestamp() if now is None else now
    extension = F.coalesce(
        lookup(media["mime_type"], MIME_EXTENSIONS), lookup(F.upper(kind), DEFAULT_EXTENSIONS), F.lit(".unknown")
    )
    stamp = F.coalesce(
        F.date_format(media["date"], "yyyy-MM-dd HH:mm:ss"), F.date_format(now, "yyyy-MM-dd_HH-mm-ss")
    )
    named = F.coalesce(filled(media["file_name"]), F.concat(kind, F.lit("_"), stamp, F.lit("."), extension))
    text = lambda c: F.coalesce(c, F.lit("None"))
    sticker = F.concat(
        F.lit("sticker_"), text(media["set_name"]), F.lit("_"), text(media["emoji"]), F.lit("_"),
        text(media["file_unique_id"]), F.lit(".webp"),
    )
    name = F.when(kind == "sticker", sticker).otherwise(named)
    dotted = F.instr(name, ".") > 0
    stem = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    tail = F.when(dotted, F.substring_index(name, ".", -1)).otherwise(F.lit("unknown"))
    return F.concat(stem, F.lit("_"), text(media["file_unique_id"]), F.lit("."), tail)


def disk_name(file_name: Column) -> Column:
    """The listed name as written to disk."""
    return F.replace(file_name, F.lit(":"), F.lit("-"))


def media_directory(file_type: Column) -> Column:
    """``VIDEO_NOTE`` becomes ``video notes``; a missing type goes to ``unknown_files``."""
    return F.coalesce(F.replace(F.lower(F.concat(file_type, F.lit("s"))), F.lit("_"), F.lit(" ")), F.lit("unknown_files"))
