"""Forum topics: reading, refreshing, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_topic_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``id<TAB>title`` lines; blank lines, lines without a tab and ids that are no whole numbers are skipped."""
    text = F.col(line)
    cut = F.instr(text, "\t")
    topic_id = F.expr(f"try_cast(trim(substring({line}, 1, instr({line}, '\t') - 1)) as bigint)")
    rest = [c for c in lines.columns if c != line]
    return (
        lines.where((F.length(F.trim(text)) > 0) & (cut > 0))
        .select(*rest, topic_id.alias("topic_id"), F.expr(f"substring({line}, instr({line}, '\t') + 1)").alias("title"))
        .where("topic_id is not null")
    )


def parse_topic_json(files: DataFrame, content: str = "content") -> DataFrame:
    """Entries of JSON objects of strings, with whole numbers as keys; other values and keys are skipped."""
    rest = [c for c in files.columns if c != content]
    variant = files.select(*rest, F.parse_json(F.col(content)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    entries = variant.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return (
        entries.where(F.schema_of_variant("value") == "STRING")
        .select(*rest, F.expr("try_cast(key as bigint)").alias("topic_id"), F.expr("variant_get(value, '$', 'string')").alias("title"))
        .where("topic_id is not null")
    )


def load_topics(files: DataFrame) -> DataFrame:
    """Topics of ``(chat_id, json, txt)``: the JSON text if it is an object, even an empty one, else the lines."""
    is_object = F.coalesce(F.schema_of_variant(F.parse_json("json")).startswith("OBJECT"), F.lit(False))
    from_json = parse_topic_json(files.where(is_object).select("chat_id", F.col("json").alias("content")))
    lines = files.where(~is_object).select("chat_id", F.explode(F.split("txt", r"\R")).alias("line"))
    return from_json.unionByName(parse_topic_lines(lines))


def upsert_topics(old: DataFrame, fetched: DataFrame, full: bool = False) -> DataFrame:
    """Fetched topics over the old ones; a full refresh replaces the topics of the chats that it holds."""
    keys = ["chat_id"] if full else ["chat_id", "topic_id"]
    kept = old.join(fetched.select(*keys).distinct(), keys, "left_anti")
    return fetched.unionByName(kept.select(*fetched.columns))


def threads_with_topic(messages: DataFrame, topics: DataFrame, known: bool = True) -> DataFrame:
    """Messages whose thread is (or with ``known=False`` is not) a known topic."""
    keys = topics.select("chat_id", F.col("topic_id").alias("reply_to_top_message_id")).distinct()
    in_thread = messages.where("reply_to_top_message_id is not null")
    return in_thread.join(keys, ["chat_id", "reply_to_top_message_id"], "left_semi" if known else "left_anti")


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None = None, size: int = 100) -> DataFrame:
    """The next page of rows in descending order of the key columns, below the key ``after``."""
    if after is not None:
        bound: Column = F.struct(*(F.lit(x).alias(c) for c, x in zip(order, after, strict=True)))
        rows = rows.where(F.struct(*order) < bound)
    return rows.orderBy(*(F.desc(c) for c in order)).limit(size)


def reached_by_paging(rows: DataFrame, group: str, order: list[str], valid: Column, size: int = 100) -> DataFrame:
    """The valid rows that paging through each group brings out, in descending order of the key columns.

    A page holds ``size`` rows below the cursor, the cursor is the last valid row of the page before, and paging ends
    at an empty page, a page without a valid row, or a short page. So a valid row is reached if no two valid rows before
    it, nor the start and the first one, lie more than ``size`` places apart; that is taken in one pass over all groups
    instead of page by page. A group is the topics of one chat.
    """
    listed = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    upto = listed.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"_place": F.row_number().over(listed), "_valid": F.coalesce(valid, F.lit(False))})
    gap = F.col("_place") - F.coalesce(F.lag("_place").over(listed), F.lit(0))
    linked = placed.where("_valid").withColumn("_broken", (gap > size).cast("int"))
    return linked.withColumn("_broken", F.max("_broken").over(upto)).where("_broken = 0").drop("_place", "_valid", "_broken")


def clean_title(title: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(title, r"[\s\p{Z}]+", " "))


def forum_flags(state: DataFrame, channels: DataFrame) -> DataFrame:
    """Whether each chat is a forum: a supergroup that the channel rows call one; unknown channels are none.

    Of several channel rows of one id the first by ``ord`` counts, if there is such a column, else any true one.
    """
    if "ord" in channels.columns:
        flag = F.min_by("is_forum", "ord")
    else:
        flag = F.bool_or("is_forum")
    known = channels.groupBy("id").agg(flag.alias("is_forum"))
    kind = F.substring_index("chat_type", ".", -1)
    joined = state.select("id", "chat_type").join(known, "id", "left")
    return joined.select("id", (F.coalesce("is_forum", F.lit(False)) & F.coalesce(kind == "SUPERGROUP", F.lit(False))).alias("is_forum"))


def topic_entries(objects: DataFrame, payload: str = "payload") -> DataFrame:
    """Id and title of tagged topic objects; objects of another tag are skipped."""
    v = F.try_parse_json(F.col(payload))
    rest = [c for c in objects.columns if c != payload]
    tagged = objects.select(*rest, v.alias("_v")).where(F.try_variant_get("_v", "$._", "string") == "ForumTopic")
    return tagged.select(
        *rest, F.try_variant_get("_v", "$.id", "bigint").alias("topic_id"), F.try_variant_get("_v", "$.title", "string").alias("title")
    ).where("topic_id is not null")


def topics_by_id(topics: DataFrame, ids: list[int]) -> DataFrame:
    """Point look-up; the list reaches the scan as a filter."""
    return topics.where(F.col("topic_id").isin(ids))


def input_channels(peers: DataFrame, payload: str = "payload") -> DataFrame:
    """Channel references of tagged peer objects: their kind, channel, access hash, and peer and message they come from.

    References pass as they are, peers of channels become references; objects of any other tag give a null kind.
    """
    v = F.try_parse_json(F.col(payload))
    at = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    tagged = peers.select("*", v.alias("_v")).withColumn("_tag", at("_", "string"))
    kind = (
        F.when(F.col("_tag").isin("InputChannel", "InputPeerChannel"), F.lit("InputChannel"))
        .when(F.col("_tag").isin("InputChannelFromMessage", "InputPeerChannelFromMessage"), F.lit("InputChannelFromMessage"))
        .when(F.col("_tag") == "InputChannelEmpty", F.lit("InputChannelEmpty"))
    )
    filled = lambda c, name: F.when(F.col("kind") == name, c)
    return tagged.withColumn("kind", kind).select(
        *(c for c in peers.columns if c != payload), "kind", F.when(F.col("kind") != "InputChannelEmpty", at("channel_id", "bigint")).alias("channel_id"),
        filled(at("access_hash", "bigint"), "InputChannel").alias("access_hash"),
        filled(F.to_json(at("peer", "variant")), "InputChannelFromMessage").alias("peer"),
        filled(at("msg_id", "bigint"), "InputChannelFromMessage").alias("msg_id"),
    )
