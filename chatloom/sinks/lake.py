"""Partitioned tables with idempotent commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import media as fm
from chatloom.functions import text as ft


def with_partition_columns(messages: DataFrame) -> DataFrame:
    """Adds ``thread_id`` and ``bucket``."""
    return messages.withColumns({"thread_id": F.col("reply_to_top_message_id"), "bucket": ft.week_bucket(F.col("date"))})


LAYOUT = ("chat_id", "thread_id", "bucket")


def clustered(rows: DataFrame) -> DataFrame:
    """Rows of one folder brought together before writing, so that a folder gets one file and not one per task; AQE
    divides folders that are large and joins tasks that are small."""
    return rows.hint("rebalance", *LAYOUT)


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """All messages by chat, thread and bucket; null threads go to the default partition."""
    clustered(with_partition_columns(messages)).write.mode(mode).partitionBy(*LAYOUT).parquet(path)


def write_media(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with a medium only, in the same layout."""
    m = messages
    media = m.withColumn("media", fm.chosen_media(m)).where("media is not null")
    clustered(with_partition_columns(media).select("id", "media", *LAYOUT)).write.mode(mode).partitionBy(
        *LAYOUT
    ).parquet(path)


def write_batch(messages: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch under its number, so that a repeated batch replaces itself."""
    messages.withColumn("commit", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("commit").parquet(path)
