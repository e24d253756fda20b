"""Edge rows of the scalar functions with expected values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatloom.functions import media as fm
from chatloom.functions import sizes as fs
from chatloom.functions import text as ft
from chatloom.schemas import MESSAGES


def one(spark, **values):
    row = {f.name: values.get(f.name) for f in MESSAGES.fields}
    return spark.createDataFrame([row], MESSAGES)


def user(first=None, last=None, name=None, number=7):
    return {"id": number, "first_name": first, "last_name": last, "username": name}


def medium(kind="photo", **values):
    keys = ("big_file_id", "file_id", "file_unique_id", "file_name", "file_size", "mime_type", "date", "set_name", "emoji")
    return {"kind": kind} | {k: values.get(k) for k in keys}


@pytest.mark.parametrize(("date", "bucket"), [
    (dt.datetime(2024, 2, 1), "2024-02-w1"), (dt.datetime(2024, 2, 7), "2024-02-w1"), (dt.datetime(2024, 2, 8), "2024-02-w2"),
    (dt.datetime(2024, 2, 29), "2024-02-w5"), (dt.datetime(2023, 2, 28), "2023-02-w4"), (None, "unknown"),
])
def test_week_bucket(spark, date, bucket):
    assert one(spark, date=date).select(ft.week_bucket(F.col("date"))).first()[0] == bucket


@pytest.mark.parametrize(("who", "name"), [
    (user("Ann", "Lee"), "Ann Lee"), (user("", "Lee"), "Lee"), (user(None, None, "al"), "al"), (user(None, None, ""), "7"),
])
def test_display_name(spark, who, name):
    assert one(spark, from_user=who).select(ft.display_name(F.col("from_user"))).first()[0] == name


@pytest.mark.parametrize(("who", "chat", "name"), [
    (user(), {"id": 1, "title": "X", "username": None}, "7"), (None, {"id": 1, "title": "", "username": "news"}, "news"),
    (None, {"id": 1, "title": None, "username": None}, "1"), (None, None, "Unknown"),
])
def test_author_label(spark, who, chat, name):
    rows = one(spark, from_user=who, sender_chat=chat)
    assert rows.select(ft.author_label(F.col("from_user"), F.col("sender_chat"))).first()[0] == name


@pytest.mark.parametrize(("values", "body"), [
    ({"text": "", "caption": "c"}, "c"),
    ({"new_chat_members": [user("Ann", "Lee"), user()]}, "added to chat: Ann Lee, 7"),
    ({"new_chat_members": [], "left_chat_member": user("Bob")}, "left chat: Bob"),
    ({"new_chat_members": [user("Bob")], "left_chat_member": user("Bob")}, "added to chat: Bob"),
    ({"new_chat_title": ""}, None), ({"new_chat_title": "T", "delete_chat_photo": True}, "changed chat title to: T"),
    ({"delete_chat_photo": True}, "removed chat photo"), ({"channel_chat_created": True}, "created chat"),
    ({"pinned_message": {"id": 3}}, "pinned a message"), ({}, None),
])
def test_body(spark, values, body):
    rows = one(spark, **values)
    assert rows.select(ft.body(rows)).first()[0] == body


def test_text_record_without_date_and_author(spark):
    rows = one(spark, text="hi")
    assert rows.select(ft.text_record(rows)).first()[0] == "[unknown] Unknown: hi\n\n"


def test_thread_zero_is_a_directory(spark):
    rows = spark.createDataFrame([(0,), (None,)], "t long").select(ft.export_path(F.col("t"), F.lit(None).cast("timestamp"), ".txt"))
    assert [r[0] for r in rows.collect()] == ["0/unknown.txt", "unknown.txt"]


@pytest.mark.parametrize(("m", "name"), [
    (medium(file_unique_id="U", file_name="a.tar.gz"), "a.tar_U.gz"), (medium(file_unique_id="U", file_name="noext"), "noext_U.unknown"),
    (medium("sticker", file_unique_id="U", set_name="S", emoji="E", file_name="x"), "sticker_S_E_U_U.webp"),
    (medium(file_unique_id="U", date=dt.datetime(2024, 1, 2, 3, 4, 5)), "photo_2024-01-02 03:04:05._U.jpg"),
    (medium("video", file_unique_id="U", mime_type="video/webm"), "video_2026-01-01_00-00-00._U.webm"),
])
def test_media_file_name(spark, m, name):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = one(spark, photo=m)
    assert rows.select(fm.media_file_name(F.col("photo"), now)).first()[0] == name
    assert ":" not in rows.select(fm.disk_name(fm.media_file_name(F.col("photo"), now))).first()[0]


def test_media_priority(spark):
    rows = one(spark, document=medium("document"), animation=medium("animation"))
    assert rows.select(fm.chosen_media(rows)["kind"]).first()[0] == "animation"


@pytest.mark.parametrize(("n", "shown"), [
    (1, "1.00 B"), (1000, "1000.00 B"), (1001, "1.00 kB"), (33047, "33.05 kB"), (0, "0.00 qB"), (10**6, "1000.00 kB"),
    (9_223_372_036_854_775_807, "9.22 EB"), (None, None),
])
def test_human_readable(spark, n, shown):
    assert spark.createDataFrame([(n,)], "n long").select(fs.human_readable(F.col("n"), "B")).first()[0] == shown


@pytest.mark.parametrize(("value", "visible"), [("a", True), (" \t​ㅤ", False), ("", False), (None, False), ("👍", True), ("️", False)])
def test_visible(spark, value, visible):
    assert spark.createDataFrame([(value,)], "v string").select(ft.has_visible(F.col("v"))).first()[0] is visible
