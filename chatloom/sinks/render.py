"""The single-file layout: JSON arrays, text files, manifests, state and mapping files."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import media as fm
from chatloom.functions import text as ft

#: Items of a file written at once.
CHUNK = 1000


def join_to(file: IO[str], parts: Iterable[str], sep: str) -> int:
    """Writes the parts with ``sep`` between them, one after the other, and returns their number."""
    n = 0
    for n, part in enumerate(parts, 1):
        file.write(part if n == 1 else sep + part)
    return n


def write_json_array(path: str, items: Iterable[str]) -> None:
    """Writes encoded items as a JSON array, streamed; the file appears under its name once it is complete."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as file:
        file.write("[")
        join_to(file, items, ",\n")
        file.write("]")
    os.replace(path + ".new", path)


def array_end(file: IO[bytes]) -> tuple[int, bool]:
    """Where the last item of a JSON array file ends, and whether it has one; only the tail of the file is read."""

    def before(end: int) -> int:
        while end:
            start = max(0, end - 4096)
            file.seek(start)
            block = file.read(end - start).rstrip()
            if block:
                return start + len(block)
            end = start
        return 0

    end = before(file.seek(0, os.SEEK_END))
    file.seek(max(0, end - 1))
    if not end or file.read(1) != b"]":
        raise ValueError(f"{file.name} does not end a JSON list")
    last = before(end - 1)
    file.seek(max(0, last - 1))
    return last, file.read(1) != b"["


def append_json_array(path: str, items: Iterable[str]) -> None:
    """Appends encoded items to a JSON array file in place, which costs what the items cost and not what the file holds.

    No items leave the disk untouched; an empty file counts as new; a file that does not end in ``]`` is an error.
    """
    items = list(items)
    if not items:
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if not os.path.exists(path) or not os.path.getsize(path):
        write_json_array(path, items)
        return
    with open(path, "r+b") as file:
        end, filled = array_end(file)
        file.seek(end)
        file.write(((",\n" if filled else "") + ",\n".join(items) + "]").encode())
        file.truncate()


def append_text(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as file:
        file.write(text)


def replace_text(path: str, text: str) -> None:
    """Writes the whole file beside the old one and swaps them."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(path + ".new", path)


class Appender:
    """Appends to one file under the name of a commit. A repeated attempt of the same commit first takes back what the
    attempt before it had appended, so that retried tasks write their items once."""

    def __init__(self, path: str, commit: str, is_array: bool) -> None:
        self.path, self.is_array, self.mark = path, is_array, f"{path}.{commit}.start"

    def begin(self) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        if os.path.exists(self.mark):
            with open(self.mark, encoding="utf-8") as file:
                start = int(file.read())
            if os.path.exists(self.path):
                os.truncate(self.path, start)
                if self.is_array and start:
                    append_text(self.path, "]")
            return
        start = 0
        if os.path.exists(self.path) and os.path.getsize(self.path):
            with open(self.path, "rb") as file:
                start = array_end(file)[0] if self.is_array else os.path.getsize(self.path)
        replace_text(self.mark, str(start))

    def add(self, parts: list[str]) -> None:
        append_json_array(self.path, parts) if self.is_array else append_text(self.path, "".join(parts))


def render_groups(rows: DataFrame, folder: str, suffix: str, order: Iterable[str], commit: str, is_array: bool = True, pretty: bool = False) -> None:
    """Appends rows (stem, item, order columns) to ``folder/stem + suffix``, each file's rows in order.

    All rows of a file go to one task by its name, which streams them in chunks, so no file is held in memory. Null
    items are left out; a file without items is not made. Two attempts must not run at once (no speculation).
    """
    rows = rows.where("item is not null").repartition("stem").sortWithinPartitions("stem", *order)

    def write(part) -> None:
        file, stem, items = None, None, []
        for row in part:
            if row.stem != stem or len(items) >= CHUNK:
                if items:
                    file.add(items)
                items = []
                if row.stem != stem:
                    stem, file = row.stem, Appender(f"{folder}/{row.stem}{suffix}", commit, is_array)
                    file.begin()
            items.append(json.dumps(json.loads(row.item), ensure_ascii=False, indent=2) if pretty else row.item)
        if items:
            file.add(items)

    rows.select("stem", "item", *order).foreachPartition(write)
    rows.select("stem").distinct().foreachPartition(lambda part: [os.remove(f"{folder}/{r.stem}{suffix}.{commit}.start") for r in part])


def render_exports(messages: DataFrame, folder: str, commit: str | None = None, kinds: tuple[str, ...] = ("json", "medias", "txt"), order: str = "arrival_seq") -> None:
    """Appends each message to the files of its chat, thread and bucket: its JSON to ``*.messages.json``, the entry of its
    medium to ``*.medias.json``, its rendered line to ``*.txt``. ``order`` is ``id`` for a tail, which comes ascending.
    Calls under one ``commit`` name append once, calls without a name each time."""
    m, commit = messages, commit or uuid.uuid4().hex
    where = F.concat_ws("/", F.col("chat_id").cast("string"), ft.export_path(F.col("reply_to_top_message_id"), F.col("date"), ""))
    stem, by = F.coalesce(where, F.lit(ft.UNKNOWN)).alias("stem"), (order, "arrival_seq") if order != "arrival_seq" else (order,)
    if "json" in kinds:
        rows = m.select(stem, *by, F.to_json(F.struct(*m.columns)).alias("item"))
        render_groups(rows, f"{folder}/json/chats", ".messages.json", by, commit, pretty=True)
    if "medias" in kinds:
        chosen = m.select(stem, *by, fm.chosen_media(m).alias("media")).where("media is not null")
        entry = F.struct(
            fm.raw_file_id(chosen["media"]).alias("raw_file_id"), fm.media_file_name(chosen["media"]).alias("file_name"),
            chosen["media"]["file_size"].alias("file_size"), F.upper(chosen["media"]["kind"]).alias("file_type"),
        )
        rows = chosen.select("stem", *by, F.to_json(entry, {"ignoreNullFields": "false"}).alias("item")).where(fm.raw_file_id(chosen["media"]).isNotNull())
        render_groups(rows, f"{folder}/json/chats", ".medias.json", by, commit)
    if "txt" in kinds:
        render_groups(m.select(stem, *by, ft.text_record(m).alias("item")), f"{folder}/txt/chats", ".txt", by, commit, is_array=False)


def write_manifests(files: DataFrame, folder: str, commit: str | None = None) -> None:
    """Appends the entries of media to one ``<chat>.medias.json`` per chat, in the order of message and file id."""
    os.makedirs(folder, exist_ok=True)
    entry = F.to_json(F.struct("raw_file_id", "file_name", "file_size", "file_type"), {"ignoreNullFields": "false"})
    stem = F.coalesce(F.col("chat_id").cast("string"), F.lit(ft.UNKNOWN)).alias("stem")
    render_groups(files.select(stem, "message_id", "raw_file_id", entry.alias("item")), folder, ".medias.json", ("message_id", "raw_file_id"), commit or uuid.uuid4().hex)


def dump_state(state: DataFrame, path: str) -> None:
    """Rewrites ``state.json``; one row per chat, so the list is as long as the dialog list."""
    chats = [json.loads(x) for (x,) in state.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    replace_text(path, json.dumps({"chats": chats}, ensure_ascii=False, indent=2))


def dump_mapping(rows: DataFrame, key: str, name: str, json_path: str, text_path: str) -> None:
    """Key to name as a JSON map (last row wins) and as lines (all rows), in the order of the frame."""
    pairs = [tuple(r) for r in rows.select(key, name).toLocalIterator()]
    replace_text(json_path, json.dumps({str(k): v for k, v in pairs}, ensure_ascii=False, indent=2))
    replace_text(text_path, "".join(f"{k}\t{v}\n" for k, v in pairs))


def dump_topics(topics: DataFrame, json_folder: str, text_folder: str) -> None:
    """``topics.json`` and ``topics.txt`` of each chat, by rising topic id; a chat's topics fit in one file."""

    def write(part) -> None:
        for row in part:
            pairs = [(t.topic_id, t.title) for t in row.topics]
            replace_text(f"{json_folder}/{row.chat_id}/topics.json", json.dumps({str(k): v for k, v in pairs}, ensure_ascii=False, indent=2))
            replace_text(f"{text_folder}/{row.chat_id}/topics.txt", "".join(f"{k}\t{v}\n" for k, v in pairs))

    listed = F.array_sort(F.collect_list(F.struct("topic_id", "title"))).alias("topics")
    topics.groupBy("chat_id").agg(listed).foreachPartition(write)


def dump_metadata(chats: DataFrame, name: str, folder: str, only_missing: bool = False) -> None:
    """One ``<folder>/<id>/<name>.json`` per row with all its columns; with ``only_missing`` existing files stay."""

    def write(part) -> None:
        for row in part:
            path = f"{folder}/{row.id}/{name}.json"
            if not (only_missing and os.path.exists(path)):
                replace_text(path, json.dumps(json.loads(row.item), ensure_ascii=False, indent=2))

    chats.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item")).foreachPartition(write)
