"""Rollups and rendered texts by chat, thread and week of month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import media as fm
from chatloom.functions import text as ft


def bucket_rollup(messages: DataFrame) -> DataFrame:
    """Counts and marks by chat, thread and bucket."""
    m = messages
    return m.groupBy(
        "chat_id", F.col("reply_to_top_message_id").alias("thread_id"), ft.week_bucket(F.col("date")).alias("bucket")
    ).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(fm.has_media(m)).alias("n_media"),
        F.min("id").alias("min_id"), F.max("id").alias("max_id"),
    )


def text_records(messages: DataFrame, *more: str) -> DataFrame:
    """Path and text of each message with a body. ``more`` columns of the messages are kept."""
    m = messages
    path = F.concat_ws("/", F.col("chat_id").cast("string"), ft.export_path(F.col("reply_to_top_message_id"), F.col("date"), ".txt"))
    return m.select("chat_id", "id", "arrival_seq", *more, path.alias("path"), ft.text_record(m).alias("text")).where("text is not null")


def joined_records(messages: DataFrame) -> DataFrame:
    """The records of one path as one text, in order of arrival. One path is one small output file."""
    return text_records(messages).groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival_seq", "text"))), lambda x: x["text"]), "").alias("text"),
        F.count(F.lit(1)).alias("n_records"),
    )
