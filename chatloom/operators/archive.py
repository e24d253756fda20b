"""An archive folder: messages, media, texts, topics and per-chat state, committed together.

A commit writes its tables under its number, then the new state, and at last renames one file that names the number;
readers see only numbers up to it. A run that stops on the way leaves nothing visible, and the next one overwrites what
it wrote under the same number, so each message is stored once. The tables are partitioned by commit and week, and
sorted by chat, so that a chat or a week is found by folders and row-group statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom import schemas
from chatloom.functions import text as ft
from chatloom.operators import media, state, sync, topics
from chatloom.operators.rollup import text_records
from chatloom.storage import commit_version, delete_path, new_path, newest_version

KINDS = ("messages", "medias", "texts")


class Archive:
    """``path`` is a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "archive")
        self.written: dict[str, dict] = {}

    # -- reading --------------------------------------------------------------------------------------------------

    def version(self) -> dict:
        """The newest commit: its number, where state and topics lie, and the last micro-batch taken in."""
        return newest_version(self.spark, f"{self.path}/commits") or {"version": 0, "state": None, "topics": None, "batch": -1, "schemas": {}}

    def _table(self, at: str | None, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return self._table(self.version()["state"], schemas.STATE)

    def topics(self) -> DataFrame:
        return self._table(self.version()["topics"], schemas.TOPICS)

    def rows(self, kind: str) -> DataFrame:
        """Committed rows of ``messages``, ``medias`` or ``texts``, with the number of their ``commit`` and their week."""
        found = self.version()
        if found["version"] and kind not in found["schemas"]:
            raise ValueError(f"the archive holds no {kind}")
        schema = T.StructType.fromJson(found["schemas"][kind]) if found["version"] else self._schema(kind)
        schema = T.StructType([*schema.fields, T.StructField("commit", T.IntegerType())])
        if not found["version"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("commit") <= found["version"])

    def _schema(self, kind: str) -> T.StructType:
        empty = self._derived(kind, self.spark.createDataFrame([], schemas.MESSAGES).withColumn("bucket", F.lit("")))
        return empty.schema

    # -- writing --------------------------------------------------------------------------------------------------

    def _put(self, kind: str, rows: DataFrame, number: int) -> DataFrame:
        target = f"{self.path}/{kind}/commit={number}"
        placed = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "chat_id")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(target)
        return self.spark.read.schema(placed.schema).parquet(target)

    def _export(self, rows: DataFrame, number: int, kinds: tuple[str, ...]) -> DataFrame:
        """Writes the rows and what is derived from them, and returns a scan of the rows."""
        week = ft.week_bucket(F.col("date")).alias("bucket") if "date" in rows.columns else F.lit(ft.UNKNOWN).alias("bucket")
        stored = self._put("messages", rows.select("*", week), number)
        self.written = {"messages": stored.schema.jsonValue()}
        for kind in sorted({*kinds} - {"messages"}):
            self.written[kind] = self._put(kind, self._derived(kind, stored), number).schema.jsonValue()
        return stored

    @staticmethod
    def _derived(kind: str, stored: DataFrame) -> DataFrame:
        if kind == "medias":
            return media.manifest(stored, F.lit(None).cast("timestamp_ntz"), "bucket")
        return text_records(stored, "bucket") if kind == "texts" else stored

    def _commit(self, before: dict, number: int, marks: DataFrame, known: DataFrame | None, batch: int) -> None:
        marks.select(*state.FIELDS).write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        listed = before["topics"]
        if known is not None:
            listed = f"{self.path}/topics/{number}"
            known.select(*schemas.TOPICS.names).write.mode("overwrite").parquet(listed)
        after = {"version": number, "state": f"{self.path}/state/{number}", "topics": listed, "batch": batch, "schemas": before["schemas"] | self.written}
        commit_version(self.spark, f"{self.path}/commits", after)
        for old in {before["state"], before["topics"]} - {after["state"], after["topics"], None}:
            delete_path(self.spark, old)

    def synchronise(self, chats: DataFrame, messages: DataFrame, revive_empty: bool = False, keep_vanished: bool = False, kinds: tuple[str, ...] = KINDS) -> int:
        """One run over the dialog list: saved state, backfill or tail of each chat, tables, new state; returns its number.

        Of several rows of a dialog the least counts. ``revive_empty`` reads chats again that an earlier run found empty.
        """
        before = self.version()
        number = before["version"] + 1
        merged = state.merge_state(state.one_row_each(chats), self.state(), keep_vanished)
        rows, after = sync.advance(messages, merged, revive_empty)
        self._export(rows, number, kinds)
        self._commit(before, number, after, None, before["batch"])
        return number

    def append(self, messages: DataFrame, batch: int, chats: DataFrame | None = None, listed: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> None:
        """Takes in one micro-batch: rows above the marks of their chats, state of chats first seen, topics first seen.

        Rows that are late by id, with no tolerance, or have no chat or id are dropped. A batch that is committed already
        is left alone. ``chats`` describes chats, ``listed`` is the source of topic titles.
        """
        before = self.version()
        if batch <= before["batch"]:
            return
        number, saved = before["version"] + 1, self.state()
        # Marks are judged on keys alone; whole rows take part in one join by their unique order of arrival.
        keys = messages.where("chat_id is not null and id is not null").select("chat_id", "id", "arrival_seq")
        fresh = sync.live_accepted(keys, saved.select(F.col("id").alias("chat_id"), F.col("latest_message_id").alias("mark")))
        rows = messages if set(messages.columns) == set(keys.columns) else messages.join(fresh, ["chat_id", "id", "arrival_seq"], "left_semi")
        stored = self._export(fresh if rows is messages else rows, number, kinds)
        read = state.progress_of(stored)
        seen = read.select(F.col("chat_id").alias("id"))
        named = state.one_row_each(chats).join(seen, "id", "right") if chats is not None else state.unnamed(seen)
        marks = state.ensure_chats(saved, named).join(
            read.select(F.col("chat_id").alias("id"), F.col("oldest_message_id").alias("_low"), F.col("latest_message_id").alias("_high")), "id", "left"
        ).withColumns({
            "oldest_message_id": F.least("oldest_message_id", "_low"), "latest_message_id": F.greatest("latest_message_id", "_high"),
        })
        known = None
        if listed is not None:
            old = self.topics()
            missing = topics.threads_with_topic(stored, old, known=False).select("chat_id", F.col("reply_to_top_message_id").alias("topic_id")).distinct()
            titles = listed.groupBy("chat_id", "topic_id").agg(F.max("title").alias("title"))
            known = topics.upsert_topics(old, titles.join(missing, ["chat_id", "topic_id"], "left_semi").select(*schemas.TOPICS.names))
        self._commit(before, number, marks, known, batch)
