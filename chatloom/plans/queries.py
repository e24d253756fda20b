"""One query per operator; each takes (spark, table directory) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.functions import media as fm
from chatloom.functions import sizes as fs
from chatloom.functions import text as ft
from chatloom.operators import delivery, media, nested, rollup, state, sync, topics
from chatloom.operators.archive import KINDS, Archive
from chatloom.schemas import MEDIA_SLOTS, MESSAGES
from chatloom.sinks.render import write_manifests
from chatloom.sources.files import load_tagged, read_manifests, table
from chatloom.sources.paged import load_history
from chatloom.storage import new_path
from chatloom.streaming.live import run_live

BATCH = 1000
SMALL_BATCH = 10
PAGE = 100
SMALL_PAGE = 2


def _now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def bucket_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.bucket_rollup(table(spark, d, "messages"))


def week_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    bucket = ft.week_bucket(F.col("date")).alias("bucket")
    return table(spark, d, "messages").groupBy(bucket).agg(F.count(F.lit(1)).alias("n_messages"))


def state_merge(spark: SparkSession, d: str) -> DataFrame:
    chats = table(spark, d, "chats").distinct()
    return state.merge_state(chats, state.current_state(table(spark, d, "chat_state")))


def current_state(spark: SparkSession, d: str) -> DataFrame:
    s = state.current_state(table(spark, d, "chat_state"))
    return s.select(*state.FIELDS, "ord").withColumn("chat_type", state.type_name(F.col("chat_type")))


def ensure_chat_state(spark: SparkSession, d: str) -> DataFrame:
    saved = state.current_state(table(spark, d, "chat_state")).where("history_complete")
    chats = table(spark, d, "chats").groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("type", "title", "username", "first_name", "last_name"))
    )
    return state.ensure_chats(saved, chats)


def chat_brief(spark: SparkSession, d: str) -> DataFrame:
    return state.chat_brief(table(spark, d, "chats"))


def chat_mapping_dedup(spark: SparkSession, d: str) -> DataFrame:
    return state.chat_mapping(table(spark, d, "chat_state"))


def chat_mapping_lines(spark: SparkSession, d: str) -> DataFrame:
    return state.chat_mapping_lines(table(spark, d, "chat_state"))


def dense_chat_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.dense_type_counts(table(spark, d, "chats"))


def chat_progress(spark: SparkSession, d: str) -> DataFrame:
    return state.progress_of(table(spark, d, "messages"))


def running_state(spark: SparkSession, d: str) -> DataFrame:
    return state.running_marks(table(spark, d, "messages"))


def state_validation(spark: SparkSession, d: str) -> DataFrame:
    """State rows written as JSON with faults by position, read back through validation."""
    s = table(spark, d, "chat_state")
    pick = F.col("ord") % 8
    name = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("qualname", F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    record = F.concat(
        F.lit('{"id": '), F.when(pick == 1, F.concat(F.lit('"'), "id", F.lit('"'))).when(pick == 2, F.lit("1.5")).otherwise(F.col("id").cast("string")),
        F.lit(', "chat_type": "'), F.col("chat_type"), F.lit('", "username": null, "qualname": '),
        F.when(pick == 3, F.lit("null")).otherwise(name),
        F.when(pick == 4, F.lit("")).when(pick == 5, F.lit(', "history_complete": null')).otherwise(F.concat(F.lit(', "history_complete": '), F.col("history_complete").cast("string"))),
        F.lit(', "oldest_message_id": '), F.when(pick == 6, F.lit("[1]")).otherwise(F.coalesce(F.col("oldest_message_id").cast("string"), F.lit("null"))),
        F.lit(', "latest_message_id": '), F.coalesce(F.col("latest_message_id").cast("string"), F.lit("null")), F.when(pick == 7, F.lit("")).otherwise(F.lit("}")),
    )
    return state.validate_state(s.select(record.alias("record")))


def tail_incremental(spark: SparkSession, d: str) -> DataFrame:
    marks = state.current_state(table(spark, d, "chat_state"))
    return sync.tail(table(spark, d, "messages"), marks).select("chat_id", "id", "arrival_seq")


def backfill_resume(spark: SparkSession, d: str) -> DataFrame:
    """Resumes chats whose history was read down to the middle of its ids."""
    half = F.floor((F.col("oldest_message_id") + F.col("latest_message_id")) / 2)
    marks = state.current_state(table(spark, d, "chat_state")).withColumns(
        {"history_complete": F.lit(False), "oldest_message_id": half}
    )
    return sync.backfill(table(spark, d, "messages"), marks).select("chat_id", "id", "arrival_seq")


def backfill_batches(spark: SparkSession, d: str) -> DataFrame:
    return sync.batch_summary(table(spark, d, "messages").select("chat_id", "id", "arrival_seq"), SMALL_BATCH).drop("counter")


def batch_counter(spark: SparkSession, d: str) -> DataFrame:
    return sync.batch_summary(table(spark, d, "messages").select("chat_id", "id", "arrival_seq"), BATCH).select(
        "chat_id", "batch_no", "counter"
    )


def sync_state(spark: SparkSession, d: str) -> DataFrame:
    marks = state.current_state(table(spark, d, "chat_state")).select("id", "history_complete", "oldest_message_id", "latest_message_id")
    return sync.synchronise(table(spark, d, "messages").select("chat_id", "id"), marks)[1]


def live_high_water(spark: SparkSession, d: str) -> DataFrame:
    return sync.live_accepted(table(spark, d, "messages").select("chat_id", "id", "arrival_seq"))


def live_stream(spark: SparkSession, d: str) -> DataFrame:
    keys = StructType([MESSAGES[c] for c in ("chat_id", "id", "arrival_seq")])
    archive = run_live(spark, f"{d}/messages.parquet*", kinds=(), schema=keys)  # as a glob it may be a file or a folder
    return archive.rows("messages").select(*keys.names)


def _state_and_counts(archive: Archive) -> DataFrame:
    """State rows with the number of rows the archive holds of each chat."""
    per = lambda kind: archive.rows(kind).groupBy(F.col("chat_id").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{kind}"))
    marks = archive.state().select("id", "history_complete", "oldest_message_id", "latest_message_id")
    counted = marks.join(per("messages"), "id", "left").join(per("medias"), "id", "left").join(per("texts"), "id", "left")
    return counted.fillna(0, [f"n_{kind}" for kind in KINDS])


def sync_job(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over all chats into an archive: first what committed backfill batches hold, then everything."""
    archive, chats, m = Archive(spark), table(spark, d, "chats"), table(spark, d, "messages")
    for rows in (_deliveries(m, table(spark, d, "export_batches"))[0], m):
        archive.synchronise(chats, rows)
    return _state_and_counts(archive)


def live_append(spark: SparkSession, d: str) -> DataFrame:
    """All messages streamed into an archive: state, rows, and the topics discovered on the way, of each chat."""
    archive = run_live(spark, f"{d}/messages.parquet*", chats=table(spark, d, "chats"), listed=table(spark, d, "topics"))
    found = archive.topics().groupBy(F.col("chat_id").alias("id")).agg(F.count(F.lit(1)).alias("n_topics"))
    return _state_and_counts(archive).join(found, "id", "left").fillna(0, ["n_topics"])


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """The manifest entries of all chats, written as files and read back."""
    folder = new_path(spark, "manifests")
    write_manifests(table(spark, d, "media_manifest"), folder.removeprefix("file:"))
    return read_manifests(spark, folder).select("raw_file_id", "file_name", "file_size", "file_type")


def topic_paging(spark: SparkSession, d: str) -> DataFrame:
    """Topics reached by paging through each chat; titles of white space alone stand for entries that are no topics."""
    t = table(spark, d, "topics").groupBy("chat_id", "topic_id").agg(F.max("title").alias("title"))
    reached = topics.reached_by_paging(t, "chat_id", ["topic_id"], topics.clean_title(F.col("title")) != "", SMALL_PAGE)
    return reached.select("chat_id", "topic_id", "title")


def topic_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics")
    return t.select("chat_id", "topic_id", topics.clean_title(F.col("title")).alias("title"))


def _topic_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All topics under their first title; those listed under several titles, under their last."""
    named = table(spark, d, "topics").groupBy("chat_id", "topic_id").agg(
        F.min("title").alias("first"), F.max("title").alias("last")
    )
    old = named.select("chat_id", "topic_id", F.col("first").alias("title"))
    return old, named.where("first <> last").select("chat_id", "topic_id", F.col("last").alias("title"))


def topic_upsert(spark: SparkSession, d: str) -> DataFrame:
    return topics.upsert_topics(*_topic_sides(spark, d))


def topic_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chats with a renamed topic are refreshed with all their topics."""
    old, renamed = _topic_sides(spark, d)
    last = table(spark, d, "topics").groupBy("chat_id", "topic_id").agg(F.max("title").alias("title"))
    return topics.upsert_topics(old, last.join(renamed.select("chat_id").distinct(), "chat_id", "left_semi"), full=True)


def topic_exists(spark: SparkSession, d: str) -> DataFrame:
    found = topics.threads_with_topic(table(spark, d, "messages"), table(spark, d, "topics"))
    return found.select("chat_id", "id", "reply_to_top_message_id", "arrival_seq")


def topic_unknown(spark: SparkSession, d: str) -> DataFrame:
    found = topics.threads_with_topic(table(spark, d, "messages"), table(spark, d, "topics"), known=False)
    return found.select("chat_id", "reply_to_top_message_id").distinct()


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").groupBy("chat_id", "topic_id").agg(F.max("title").alias("title"))
    return topics.keyset_page(t, ["topic_id", "chat_id"], (40, 0), PAGE)


def forum_chats(spark: SparkSession, d: str) -> DataFrame:
    """Chats with topics are taken for forum channels."""
    channels = table(spark, d, "topics").groupBy(F.col("chat_id").alias("id")).agg(F.lit(True).alias("is_forum"))
    return topics.forum_flags(state.current_state(table(spark, d, "chat_state")), channels)


def topic_lookup(spark: SparkSession, d: str) -> DataFrame:
    return topics.topics_by_id(table(spark, d, "topics"), [3, 8, 11, 13, 24]).select("chat_id", "topic_id", "title")


def chat_avatars(spark: SparkSession, d: str) -> DataFrame:
    listed = media.avatars(table(spark, d, "messages"))
    return listed.select("chat_id", F.size("photos").cast("long").alias("n_photos"), F.array_join("photos", ",").alias("photos"))


def media_queue(spark: SparkSession, d: str) -> DataFrame:
    """Files to fetch per chat."""
    files = table(spark, d, "media_manifest").where("raw_file_id is not null")
    return files.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("total_bytes"))


def message_media_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each of the two lake tables gets, by chat."""
    m = table(spark, d, "messages")
    return m.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(fm.has_media(m)).alias("n_medias"))


def topic_lines(spark: SparkSession, d: str) -> DataFrame:
    """Topics written as text lines, some malformed, read back."""
    t = table(spark, d, "topics")
    pick = F.col("topic_id") % 5
    line = F.when(pick == 0, F.concat(F.lit("x"), "topic_id", F.lit("\t"), "title")).when(pick == 1, F.col("title")).otherwise(
        F.concat(F.lit(" "), "topic_id", F.lit("\t"), "title", F.lit("\tend"))
    )
    return topics.parse_topic_lines(t.select("chat_id", line.alias("line")))


def topics_fallback(spark: SparkSession, d: str) -> DataFrame:
    """JSON topics where the text is an object, else lines."""
    t = table(spark, d, "topics").groupBy("chat_id").agg(F.min("topic_id").alias("k"))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"'), "k", F.lit('": "json", "a": "b"}'))).when(F.col("k") % 3 == 1, F.lit("[]")).otherwise(F.lit("{}"))
    return topics.load_topics(t.select("chat_id", text.alias("json"), F.concat("k", F.lit("\ttext\nno tab")).alias("txt")))


def event_text_case(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return m.select("chat_id", "id", "arrival_seq", ft.event_text(m).alias("event")).where("event is not null")


def author_label(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return m.select("arrival_seq", ft.author_label(F.col("from_user"), F.col("sender_chat")).alias("author"))


def text_render(spark: SparkSession, d: str) -> DataFrame:
    return rollup.text_records(table(spark, d, "messages"))


def text_concat(spark: SparkSession, d: str) -> DataFrame:
    return rollup.joined_records(table(spark, d, "messages"))


def media_coalesce(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    chosen = m.select("arrival_seq", fm.chosen_media(m).alias("media")).where("media is not null")
    return chosen.select("arrival_seq", "media.kind", "media.file_unique_id")


def media_filename(spark: SparkSession, d: str) -> DataFrame:
    files = media.targets(media.manifest(table(spark, d, "messages"), _now()))
    return files.select("arrival_seq", "raw_file_id", "file_name", "file_size", "file_type", "directory", "disk_name")


def media_directories(spark: SparkSession, d: str) -> DataFrame:
    kind = fm.media_directory(F.col("file_type")).alias("directory")
    return table(spark, d, "media_manifest").groupBy(kind).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("total_bytes")
    )


def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "media_manifest").where("raw_file_id is not null")
    there = media.targets(files.where("message_id % 4 = 0")).select("chat_id", "directory", "disk_name").distinct()
    return media.missing_files(files, there).select("chat_id", "message_id", "directory", "disk_name")


def human_readable_size(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "media_manifest").select("file_size").distinct()
    return files.select("file_size", fs.human_readable(F.col("file_size"), "B").alias("shown"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, d, "events").groupBy("event_type", k).agg(F.count(F.lit(1)).alias("n"))


def tagged_load(spark: SparkSession, d: str) -> DataFrame:
    rows = load_tagged(table(spark, d, "raw_messages"), {"Message": "id long, date string"}, strict=False)
    return rows.select("raw_id", "tag", F.col("Message.id").alias("id"), F.col("Message.date").alias("date"))


def paged_history(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the table through the paged source."""
    history = load_history(spark, f"{d}/messages.parquet")
    return history.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("latest_message_id"))


def media_slots_used(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    used = m.agg(*(F.count(m[s]["kind"]).alias(s) for s in MEDIA_SLOTS))
    return used.unpivot([], list(MEDIA_SLOTS), "slot", "n_messages")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.flatten(table(spark, d, "raw_messages"), "raw_id", "payload", values=False)
    return nested.child_links(nodes, "raw_id")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "raw_messages"), "raw_id", "payload")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its parent, its schema path and its kind."""
    nodes = nested.flatten(table(spark, d, "raw_messages"), "raw_id", "payload", values=False)
    return nodes.select("raw_id", "node_path", "parent_path", "schema_path", "kind")


def p4_users(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of one kind."""
    nodes = nested.flatten(table(spark, d, "raw_messages"), "raw_id", "payload")
    users = nested.flat_table(nodes, "raw_id", "User", ("id", "first_name"))
    return users.select("raw_id", "node_path", "parent_path", "id", "first_name")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of all kinds with all their fields, and where each was written."""
    nodes = nested.flatten(table(spark, d, "raw_messages"), "raw_id", "payload")
    return nested.write_tables(nodes, "raw_id")


def _deliveries(messages: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Committed backfill batches are the history, all other rows arrive after it."""
    old = batches.where("phase = 'backfill' and committed").select("batch_id").distinct()
    history, incoming = messages.join(old, "batch_id", "left_semi"), messages.join(old, "batch_id", "left_anti")
    return history.select(*messages.columns), incoming.select(*messages.columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies to be removed."""
    m = table(spark, d, "messages").select("chat_id", "id", "arrival_seq", "batch_id")
    return delivery.deduplicate(*_deliveries(m, table(spark, d, "export_batches")), delivery.DeliveryStore(spark))


def p5_whole_messages(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each message with all its columns, read out of the store after both merges."""
    return delivery.kept_copies(*_deliveries(table(spark, d, "messages"), table(spark, d, "export_batches")), delivery.DeliveryStore(spark))


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    """The first copy of each message with its text and date, read out of the store after both merges."""
    m = table(spark, d, "messages").select("chat_id", "id", "arrival_seq", "batch_id", "date", "text", "caption")
    return delivery.kept_copies(*_deliveries(m, table(spark, d, "export_batches")), delivery.DeliveryStore(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        bucket_rollup, week_bucket_counts, state_merge, current_state, ensure_chat_state, chat_brief,
        chat_mapping_dedup, chat_mapping_lines, dense_chat_type_counts, chat_progress, running_state, state_validation,
        tail_incremental, backfill_resume, backfill_batches, batch_counter, sync_state, live_high_water, live_stream, sync_job, live_append,
        manifest_scan, topic_paging,
        topic_titles, topic_upsert, topic_replace, topic_exists, topic_unknown, keyset_page, topic_lines,
        forum_chats, topic_lookup, chat_avatars, media_queue, message_media_split,
        topics_fallback, event_text_case, author_label, text_render, text_concat, media_coalesce, media_filename,
        media_directories, skip_existing, human_readable_size, json_props, tagged_load, paged_history,
        media_slots_used, p4_found, p4_nodes, p4_paths, p4_users, p4_tables, p5_found, p5_messages,
        p5_whole_messages,
    )
    return {f.__name__: f for f in named}
