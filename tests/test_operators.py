"""State, synchronisation, topics, files and streams on small rows."""

import json
import logging
from pathlib import Path

import pytest

from chatloom.config import SyncConfig, bool_setting, configure_logging, int_setting, text_setting
from chatloom.functions.sizes import human_readable_float
from chatloom.operators import media, state, sync, topics
from chatloom.operators.resume import ResumeIndex
from chatloom.plans.queries import queries
from chatloom.sinks import lake, render
from chatloom.sources import files
from chatloom.streaming import live

STATE = "id long, chat_type string, username string, qualname string, history_complete boolean, oldest_message_id long, latest_message_id long, ord long"


def records(spark, *values):
    return spark.createDataFrame([(json.dumps(v) if not isinstance(v, str) else v,) for v in values], "record string")


def test_validation_drops_wrong_types(spark):
    good = {"id": 1, "chat_type": "BOT", "qualname": "x", "username": None, "oldest_message_id": None, "latest_message_id": 9}
    rows = records(
        spark, good, good | {"id": "1"}, good | {"history_complete": None}, good | {"qualname": None},
        good | {"latest_message_id": "9"}, good | {"id": 1.5}, good | {"id": True}, "[1]", "{", "null",
    )
    got = [tuple(r) for r in state.validate_state(rows).collect()]
    assert got == [(1, "BOT", None, "x", False, None, 9)] * 2


def test_merge_keeps_dialogs_and_drops_vanished(spark):
    chats = spark.createDataFrame([(1, "GROUP", "A", None, None, None), (2, "PRIVATE", None, "u", "F", "L")], "id long, type string, title string, username string, first_name string, last_name string")
    saved = spark.createDataFrame([(2, "PRIVATE", None, "old", True, 1, 9, 1), (3, "BOT", None, "gone", True, 1, 2, 2)], STATE)
    got = {r.id: r for r in state.merge_state(chats, saved).collect()}
    assert set(got) == {1, 2} and got[1].history_complete is False and got[1].latest_message_id is None
    assert (got[2].qualname, got[2].latest_message_id) == ("F L", 9)
    assert {r.id for r in state.merge_state(chats, saved, keep_vanished=True).collect()} == {1, 2, 3}


def test_brief_may_be_null(spark):
    chats = spark.createDataFrame([(1, "BOT", None, None, None, None), (2, "ODD", "t", None, None, None)], "id long, type string, title string, username string, first_name string, last_name string")
    assert [r.qualname for r in state.chat_brief(chats).orderBy("id").collect()] == [None, "unknown"]


def test_dense_counts_keep_zero(spark):
    chats = spark.createDataFrame([("PRIVATE",), ("PRIVATE",)], "type string")
    assert {r.chat_type: r.n_chats for r in state.dense_type_counts(chats).collect()} == {"PRIVATE": 2, "BOT": 0, "GROUP": 0, "SUPERGROUP": 0, "CHANNEL": 0}


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), "chat_id long, id long, arrival_seq long")


def test_tail_and_backfill(spark):
    m = messages(spark, *[(1, i, i) for i in range(1, 16)], (2, 5, 1), (3, 1, 1))
    s = spark.createDataFrame([(1, None, None, "a", True, 2, 10, 1), (2, None, None, "b", False, 6, 9, 1), (3, None, None, "c", True, None, None, 1)], STATE)
    rows, after = sync.synchronise(m, s)
    assert sorted((r.chat_id, r.id, r.branch) for r in rows.collect()) == [(1, i, "tail") for i in range(11, 16)] + [(2, 5, "backfill")]
    got = {r.id: (r.oldest_message_id, r.latest_message_id, r.history_complete) for r in after.collect()}
    assert got == {1: (2, 15, True), 2: (5, 9, True), 3: (None, None, True)}


def test_zero_and_null_marks_read_all(spark):
    m = messages(spark, (1, 4, 1), (2, 4, 1))
    s = spark.createDataFrame([(1, None, None, "a", False, 0, None, 1), (2, None, None, "b", False, None, None, 1)], STATE)
    assert sync.backfill(m, s).count() == 2


def small_beside_unknown(spark):
    """Messages that Spark takes for small, as it does with keys of wide rows, and state of unknown size."""
    m = spark.range(1, 16).selectExpr("id div 100 + 1 as chat_id", "id", "id as arrival_seq")
    return m, lambda *s: spark.createDataFrame([(*s, 1)], STATE)


def broadcast_left(df):
    return "BuildLeft" in df._jdf.queryExecution().executedPlan().toString()


def test_synchronising_never_broadcasts_messages(spark):
    m, state_of = small_beside_unknown(spark)
    for s, want in (((1, None, None, "a", True, 2, 10), (2, 15)), ((1, None, None, "a", False, 6, 9), (1, 9))):
        rows, after = sync.synchronise(m, state_of(*s))
        assert not broadcast_left(rows) and not broadcast_left(after)
        assert [(r.oldest_message_id, r.latest_message_id) for r in after.collect()] == [want]


def test_backfill_never_broadcasts_messages(spark):
    m, state_of = small_beside_unknown(spark)
    rows = sync.backfill(m, state_of(1, None, None, "a", False, 4, 9))
    assert not broadcast_left(rows) and sorted(r.id for r in rows.collect()) == [1, 2, 3]


def test_tail_never_broadcasts_messages(spark):
    m, state_of = small_beside_unknown(spark)
    rows = sync.tail(m, state_of(1, None, None, "a", True, 4, 13))
    assert not broadcast_left(rows) and sorted(r.id for r in rows.collect()) == [14, 15]


def test_batches_of_fixed_size(spark):
    m = messages(spark, *[(1, i, i) for i in range(1, 24)])
    got = [(r.batch_no, r.n_rows, r.oldest_message_id, r.latest_message_id, r.counter) for r in sync.batch_summary(m, 10).orderBy("batch_no").collect()]
    assert got == [(0, 10, 14, 23, 10), (1, 10, 4, 13, 20), (2, 3, 1, 3, 23)]


def test_live_drops_late_rows(spark):
    m = messages(spark, *[(1, i, k) for k, i in enumerate([5, 3, 5, 6, 1, 9])])
    assert [r.id for r in sync.live_accepted(m).orderBy("arrival_seq").collect()] == [5, 6, 9]


def test_stream_equals_batch(spark, data):
    table = files.table(spark, data, "messages").select("chat_id", "id", "arrival_seq")
    got = {tuple(r) for r in live.run_live(spark, f"{data}/messages.parquet*").rows("messages").select("chat_id", "id", "arrival_seq").collect()}
    assert got == {tuple(r) for r in sync.live_accepted(table).collect()}


def test_repeated_batch_replaces_itself(spark, tmp_path):
    m = messages(spark, (1, 1, 1))
    for number in (0, 1, 1):
        lake.write_batch(m, number, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_topic_lines(spark):
    lines = spark.createDataFrame([("5\tA\tB",), ("x\tA",), ("7",), ("  ",), (" 10 \tT",)], "line string")
    assert sorted(map(tuple, topics.parse_topic_lines(lines).collect())) == [(5, "A\tB"), (10, "T")]


def test_topics_fall_back_only_without_an_object(spark):
    rows = spark.createDataFrame([(1, "[]", "5\tT"), (2, "{}", "5\tT"), (3, '{"a": "x", "5": "t", "6": 7}', None), (4, None, "6\tU")], "chat_id long, json string, txt string")
    assert sorted(map(tuple, topics.load_topics(rows).collect())) == [(1, 5, "T"), (3, 5, "t"), (4, 6, "U")]


def test_topic_upsert_and_replace(spark):
    schema = "chat_id long, topic_id long, title string"
    old, new = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema), spark.createDataFrame([(1, 2, "c"), (1, 3, "d")], schema)
    assert sorted(map(tuple, topics.upsert_topics(old, new).collect())) == [(1, 1, "a"), (1, 2, "c"), (1, 3, "d")]
    assert sorted(map(tuple, topics.upsert_topics(old, new, full=True).collect())) == [(1, 2, "c"), (1, 3, "d")]


def test_keyset_pages_cover_all_rows(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(25)], "a long, b long")
    after, seen = None, []
    while page := [tuple(r) for r in topics.keyset_page(rows, ["a", "b"], after, 10).collect()]:
        seen += page
        after = page[-1]
    assert seen == [(i // 3, i) for i in range(24, -1, -1)]


def test_json_array_append(tmp_path):
    path = str(tmp_path / "x" / "a.json")
    render.append_json_array(path, [])
    assert not (tmp_path / "x").exists()
    for text, want in (("[]", "[b]"), ("", "[b]"), ("[a]\n", "[a,\nb]")):
        (tmp_path / "x").mkdir(exist_ok=True)
        (tmp_path / "x" / "a.json").write_text(text)
        render.append_json_array(path, ["b"])
        assert (tmp_path / "x" / "a.json").read_text() == want
    for text in ("   ", "[a}"):
        (tmp_path / "x" / "a.json").write_text(text)
        with pytest.raises(ValueError):
            render.append_json_array(path, ["b"])


def test_exports_hold_every_message(spark, data, tmp_path):
    m = files.table(spark, data, "messages").limit(300)
    m = spark.createDataFrame(m.collect(), m.schema)
    render.render_exports(m, str(tmp_path))
    items = [json.loads(p.read_text()) for p in tmp_path.rglob("*.messages.json")]
    assert sum(map(len, items)) == 300
    assert all(p.read_text().endswith("\n\n") for p in tmp_path.rglob("*.txt"))


def test_state_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, "BOT", None, "a", True, 1, 2, 1), (2, "BOT", "u", None, False, None, None, 2)], STATE).drop("ord")
    path = str(tmp_path / "state.json")
    render.dump_state(s, path)
    assert [r.id for r in files.read_state(spark, path).collect()] == [1]


def test_manifests_skip_broken_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.medias.json").write_text('[{"raw_file_id": "x", "file_name": "n", "file_size": 3}]')
    (tmp_path / "a" / "2.medias.json").write_text('[{"raw_file_id": "y"')
    (tmp_path / "a" / "3.json").write_text("[]")
    assert [r.raw_file_id for r in files.read_manifests(spark, str(tmp_path)).collect()] == ["x"]


def test_missing_files_and_fetch(spark):
    rows = spark.createDataFrame([(1, 1, "f", "a:b.jpg", 1, "PHOTO"), (1, 2, "g", "a:b.jpg", 1, "PHOTO"), (1, 3, "h", "c.mp4", 1, "VIDEO_NOTE"), (1, 4, "i", "d", 1, None)], "chat_id long, message_id long, raw_file_id string, file_name string, file_size long, file_type string")
    there = spark.createDataFrame([(1, "video notes", "c.mp4")], "chat_id long, directory string, disk_name string")
    left = media.missing_files(rows, there)
    assert sorted((r.message_id, r.directory, r.disk_name) for r in left.collect()) == [(1, "photos", "a-b.jpg"), (4, "unknown_files", "d")]

    def download(row):
        if row["disk_name"] == "d":
            raise OSError("gone")

    assert {r.disk_name: r.error for r in media.fetch(left, download, 2).collect()} == {"a-b.jpg": None, "d": "gone"}


def test_settings():
    assert bool_setting({"X": "YES "}, "X", False) is True and bool_setting({"X": "off"}, "X", True) is False
    for value in ("", "maybe"):
        with pytest.raises(ValueError):
            bool_setting({"X": value}, "X", True)
    assert text_setting({"X": " "}, "X", "d") == "d" and int_setting({}, "X", 3) == 3
    for call in (lambda: text_setting({}, "X"), lambda: int_setting({"X": ""}, "X", 3), lambda: SyncConfig(), lambda: SyncConfig(export_json=False), lambda: SyncConfig(export_json=False, export_text=True)):
        with pytest.raises(ValueError):
            call()


def test_tagged_rows(spark):
    rows = spark.createDataFrame([('{"_": "User", "id": 3}',), ('{"_": "Other"}',), ('{"id": 1}',)], "payload string")
    got = files.load_tagged(rows, {"User": "id long"}, strict=False).collect()
    assert [(r.tag, r.User.id) for r in got] == [("User", 3)]
    with pytest.raises(Exception, match="no type for tag"):
        files.load_tagged(rows, {"User": "id long"}).collect()


def test_forum_flags_and_entries(spark):
    s = spark.createDataFrame([(1, "SUPERGROUP"), (2, "ChatType.SUPERGROUP"), (3, "GROUP"), (4, None)], "id long, chat_type string")
    channels = spark.createDataFrame([(1, True, 2), (1, False, 1), (2, True, 1), (3, True, 1)], "id long, is_forum boolean, ord long")
    assert {r.id: r.is_forum for r in topics.forum_flags(s, channels).collect()} == {1: False, 2: True, 3: False, 4: False}
    objects = spark.createDataFrame([('{"_": "ForumTopic", "id": 3, "title": "T"}',), ('{"_": "Other", "id": 4}',), ("{",)], "payload string")
    assert [tuple(r) for r in topics.topic_entries(objects).collect()] == [(3, "T")]


def test_metadata_files(spark, tmp_path):
    chats = spark.createDataFrame([(1, "a"), (2, None)], "id long, title string")
    render.dump_metadata(chats, "info", str(tmp_path))
    render.dump_metadata(spark.createDataFrame([(1, "b"), (3, "c")], "id long, title string"), "info", str(tmp_path), only_missing=True)
    assert {p.parent.name: json.loads(p.read_text())["title"] for p in tmp_path.rglob("info.json")} == {"1": "a", "2": None, "3": "c"}


def test_resume_repeats_at_most_one(tmp_path):
    path, seen = str(tmp_path / "p.json"), []
    for limit in (2, 3, 9):
        for item in ResumeIndex("abcdef", path):
            seen.append(item)
            limit -= 1
            if not limit:
                break
    assert "".join(seen) == "abbcdcdef"[:2] + "bcd" + "def"
    (tmp_path / "p.json").write_text("true")
    with pytest.raises(TypeError):
        ResumeIndex("a", path).done()
    with pytest.raises(ValueError):
        ResumeIndex("a", str(tmp_path / "no" / "p.json"))


def test_every_topic_comes_out(spark, tmp_path):
    rows = [(c, t, f"{c}-{t}") for c in (1, 2, None) for t in range(13)] + [(1, 3, "renamed"), (1, 4, None)]
    spark.createDataFrame(rows, "chat_id long, topic_id long, title string").write.parquet(str(tmp_path / "topics.parquet"))
    want = {r for r in rows if r[2] and r != (1, 3, "1-3")}
    for name in ("topic_upsert", "topic_replace"):
        assert sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_channel_references(spark):
    rows = [
        (1, '{"_": "InputPeerChannel", "channel_id": 5, "access_hash": 9}'), (2, '{"_": "InputChannel", "channel_id": 6, "access_hash": 8}'), (3, '{"_": "InputChannelEmpty"}'),
        (4, '{"_": "InputPeerChannelFromMessage", "channel_id": 7, "msg_id": 3, "peer": {"_": "P"}}'), (5, '{"_": "InputPeerUser", "user_id": 1}'), (6, "{"), (7, None),
    ]
    got = [tuple(r) for r in topics.input_channels(spark.createDataFrame(rows, "k long, payload string")).orderBy("k").collect()]
    assert got == [
        (1, "InputChannel", 5, 9, None, None), (2, "InputChannel", 6, 8, None, None), (3, "InputChannelEmpty", None, None, None, None),
        (4, "InputChannelFromMessage", 7, None, '{"_":"P"}', 3), *((k, None, None, None, None, None) for k in (5, 6, 7)),
    ]


def test_environment_and_logging(tmp_path):
    found = SyncConfig.from_environment({"EXPORT_TEXT": "off", "STATE_ROOT": " /s "}, tmp_path)
    assert found == SyncConfig(True, False, tmp_path / "json", None, True, Path("/s"))
    logger = logging.getLogger("chatloom-test")
    for _ in range(2):
        configure_logging(logger, tmp_path / "state")
    logger.debug("kept in the file")
    assert len(logger.handlers) == 2 and (tmp_path / "state" / "process.log").read_text().count("kept in the file") == 1


def test_sizes_with_fractions(spark):
    cases = {0.0: "0.00 qB", 1.0: "1.00 B", 1000.0: "1000.00 B", 1000.5: "1.00 kB", 0.5: "500.00 mB", 0.001: "1000.00 µB", 2.5e-9: "2.50 nB", 3e21: "3.00 ZB", -5.0: "-5" + "0" * 30 + ".00 qB", 5e31: "50.00 QB"}
    frame = spark.createDataFrame([(x,) for x in cases] + [(None,)], "n double")
    got = {r.n: r.shown for r in frame.select("n", human_readable_float(frame["n"], "B").alias("shown")).collect()}
    assert {k: v for k, v in got.items() if k != -5.0} == {k: v for k, v in cases.items() if k != -5.0} | {None: None}
    assert got[-5.0].endswith(" qB") and got[-5.0].startswith("-5")
