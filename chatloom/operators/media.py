"""The media manifest and the files that still have to be fetched."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import media as fm


def manifest(messages: DataFrame, now=None, *more: str) -> DataFrame:
    """File id, name, size and type of each message's medium; media without a file id are left out. ``more`` columns of
    the messages are kept."""
    m = messages
    chosen = m.select("chat_id", "id", "arrival_seq", *more, fm.chosen_media(m).alias("media")).where("media is not null")
    media = chosen["media"]
    return chosen.select(
        "chat_id", F.col("id").alias("message_id"), "arrival_seq", fm.raw_file_id(media).alias("raw_file_id"),
        fm.media_file_name(media, now).alias("file_name"), media["file_size"].alias("file_size"),
        F.upper(media["kind"]).alias("file_type"), *more,
    ).where("raw_file_id is not null")


def targets(files: DataFrame) -> DataFrame:
    """Directory and disk name of each listed file."""
    return files.withColumns({
        "directory": fm.media_directory(F.col("file_type")), "disk_name": fm.disk_name(F.col("file_name")),
    })


def missing_files(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Listed files whose (chat, directory, name) is not on disk; of several with one target the first id wins, null last."""
    wanted = targets(files).join(existing, ["chat_id", "directory", "disk_name"], "left_anti")
    rest = [c for c in wanted.columns if c not in ("chat_id", "directory", "disk_name")]
    first = F.min(F.struct(F.col("message_id").isNull().alias("_unknown"), "message_id", *(c for c in rest if c != "message_id"))).alias("_f")
    return wanted.groupBy("chat_id", "directory", "disk_name").agg(first).select(
        "chat_id", "directory", "disk_name", *(F.col(f"_f.{c}").alias(c) for c in rest)
    )


def patient(call: Callable, busy: type[Exception], gone: type[Exception] | tuple = (), wait_s: float = 30, sleep: Callable = time.sleep) -> Callable:
    """Wraps a call to a rate-limited source: waits and repeats without end while it is ``busy``, null if the subject is
    ``gone``; any other error is passed on."""

    def run(*args):
        while True:
            try:
                return call(*args)
            except busy:
                sleep(wait_s)
            except gone:
                return None

    return run


def fetch(files: DataFrame, download: Callable[[dict], None], workers: int = 8) -> DataFrame:
    """Calls ``download`` for each row on ``workers`` tasks; one row per file with the error, null if it worked."""

    def run(batches):
        for pdf in batches:
            errors = []
            for row in pdf.to_dict("records"):
                try:
                    download(row)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    errors.append(str(error))
            yield pdf[["chat_id", "directory", "disk_name"]].assign(error=errors)

    return files.repartition(workers).mapInPandas(run, "chat_id long, directory string, disk_name string, error string")


def avatars(messages: DataFrame) -> DataFrame:
    """Photos set for each chat, oldest first; a chat has few of them beside its messages."""
    photo = F.col("new_chat_photo")
    rows = messages.where(photo["kind"].isNotNull()).select("chat_id", "id", "arrival_seq", photo["file_unique_id"].alias("photo"))
    listed = F.array_sort(F.collect_list(F.struct("id", "arrival_seq", "photo")))
    return rows.groupBy("chat_id").agg(F.transform(listed, lambda x: x["photo"]).alias("photos"))
