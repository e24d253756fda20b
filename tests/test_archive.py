"""Archives over runs, streams and failures; files of the single-file layout written and read back."""

import json
import random

import pytest

from chatloom.operators import archive as archives
from chatloom.operators import media, sync, topics
from chatloom.operators.archive import Archive
from chatloom.schemas import CHATS, MESSAGES, TOPICS
from chatloom.sinks import render
from chatloom.sources import files
from chatloom.streaming.live import run_live


def messages(spark, rows):
    """Rows (chat, id, arrival[, more fields])."""
    full = [{f.name: None for f in MESSAGES.fields} | {"chat_id": c, "id": i, "arrival_seq": k, "text": f"t{i}"} | (more[0] if more else {}) for c, i, k, *more in rows]
    return spark.createDataFrame(full, MESSAGES)


def chats(spark, *ids):
    return spark.createDataFrame([(i, "ChatType.GROUP", f"c{i}", None, None, None) for i in ids], CHATS)


def stored(archive):
    return sorted((r.chat_id, r.id) for r in archive.rows("messages").collect())


def test_two_runs_and_an_empty_chat(spark):
    archive = Archive(spark)
    archive.synchronise(chats(spark, 1, 1, 2), messages(spark, [(1, 5, 0), (1, 7, 1), (3, 1, 2)]))
    assert stored(archive) == [(1, 5), (1, 7)]
    later = messages(spark, [(1, 5, 0), (1, 7, 1), (1, 9, 3), (2, 4, 4)])
    archive.synchronise(chats(spark, 1, 2), later)
    assert stored(archive) == [(1, 5), (1, 7), (1, 9)]
    assert {r.id: (r.history_complete, r.oldest_message_id, r.latest_message_id) for r in archive.state().collect()} == {1: (True, 5, 9), 2: (True, None, None)}
    archive.synchronise(chats(spark, 2), later, revive_empty=True)
    assert stored(archive) == [(1, 5), (1, 7), (1, 9), (2, 4)]
    assert {r.id: r.latest_message_id for r in archive.state().collect()} == {2: 4}
    archive.synchronise(chats(spark, 1), later, keep_vanished=True)
    assert {r.id: r.latest_message_id for r in archive.state().collect()} == {1: 9, 2: 4}
    assert sum(r.n for r in archive.rows("texts").groupBy("chat_id").agg({"*": "count"}).toDF("c", "n").collect()) == len(stored(archive))


def test_run_never_broadcasts_messages(spark, tmp_path, monkeypatch):
    """Keys of wide messages look small; the rows here are known to be few, the sizes of the dialog list are unknown."""
    archive, plans, export = Archive(spark, str(tmp_path / "a")), [], Archive._export

    def noted(self, rows, number, kinds):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return export(self, rows, number, kinds)

    monkeypatch.setattr(Archive, "_export", noted)
    for top in (4, 6):
        rows = spark.range(1, top).selectExpr("id div 100 + 1 as chat_id", "id", "id as arrival_seq")
        archive.synchronise(chats(spark, 1, 2), rows, kinds=("messages",))
    assert len(plans) == 2 and not any("BuildLeft" in plan for plan in plans)
    assert stored(archive) == [(1, i) for i in range(1, 6)]


def test_a_run_that_stops_leaves_nothing_and_is_repeated(spark, monkeypatch):
    archive, rows = Archive(spark), messages(spark, [(1, 5, 0), (1, 7, 1)])

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(archives, "commit_version", stop)
        with pytest.raises(KeyboardInterrupt):
            archive.synchronise(chats(spark, 1), rows)
    assert archive.version()["version"] == 0 and archive.state().count() == 0
    archive.synchronise(chats(spark, 1), messages(spark, [(1, 5, 0)]))
    assert stored(archive) == [(1, 5)]


def test_stream_that_is_killed_gives_each_message_once(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3]), rng.randrange(200), k, {"reply_to_top_message_id": rng.choice([None, 7, 8])}) for k in range(400)]
    for part in range(4):
        messages(spark, rows[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    archive, calls = Archive(spark), []
    listed = spark.createDataFrame([(1, 7, "seven"), (1, 8, "eight"), (2, 7, "two"), (3, 99, "never")], TOPICS)
    commit = archives.commit_version

    def fail(spark_, folder, content):
        calls.append(content["version"])
        if len(calls) == 2:
            raise RuntimeError("killed before the commit")
        commit(spark_, folder, content)
        if len(calls) == 4:
            raise RuntimeError("killed after the commit")

    with monkeypatch.context() as patch:
        patch.setattr(archives, "commit_version", fail)
        for _ in range(2):
            with pytest.raises(Exception, match="killed"):
                run_live(spark, str(tmp_path / "in"), archive, chats(spark, 1, 2), listed, files_per_trigger=1)
    run_live(spark, str(tmp_path / "in"), archive, chats(spark, 1, 2), listed, files_per_trigger=1)
    keys = spark.createDataFrame([r[:3] for r in rows], "chat_id long, id long, arrival_seq long")
    assert stored(archive) == sorted((r.chat_id, r.id) for r in sync.live_accepted(keys).collect())
    assert archive.version()["batch"] == 3
    top = {c: max(i for a, i, *_ in rows if a == c) for c in (1, 2, 3)}
    state = {r.id: r for r in archive.state().collect()}
    assert {c: r.latest_message_id for c, r in state.items()} == top and not any(r.history_complete for r in state.values())
    assert state[1].qualname == "c1" and state[3].qualname == "unknown"
    threads = {(r.chat_id, r.reply_to_top_message_id) for r in archive.rows("messages").collect()}
    want = [t for t in [(1, 7, "seven"), (1, 8, "eight"), (2, 7, "two")] if t[:2] in threads]
    assert sorted(tuple(r) for r in archive.topics().collect()) == want and len(want) > 1


def test_manifests_are_written_and_read_back(spark, tmp_path):
    photo = {f: None for f in MESSAGES["photo"].dataType.names} | {"kind": "photo", "file_id": "f1", "file_name": "a.jpg", "file_unique_id": "u", "file_size": 5}
    rows = messages(spark, [(1, 1, 1, {"photo": photo}), (1, 2, 2, {"photo": photo | {"file_id": "f2"}}), (1, 3, 3, {"photo": photo | {"file_id": None}}), (2, 4, 4)])
    render.render_exports(rows, str(tmp_path), commit="a")
    for _ in range(2):  # reading twice in one process
        got = [(r.raw_file_id, r.file_name, r.file_size, r.file_type) for r in files.read_manifests(spark, str(tmp_path)).collect()]
        assert got == [("f1", "a_u.jpg", 5, "PHOTO"), ("f2", "a_u.jpg", 5, "PHOTO")]
    assert not list(tmp_path.rglob("*.start"))


def test_entries_before_a_fault_are_kept_in_the_order_of_files(spark, tmp_path):
    good, entry = '{"raw_file_id": "%s", "file_name": "n", "file_size": 3, "file_type": null}', "[%s]"
    texts = {
        "b/2": entry % ", ".join([good % "b1", good % "b2", '{"raw_file_id": 5']), "a/1": entry % (good % "a1"), "c/1": "not json",
        "d/1": entry % ", ".join([good % "d1", '{"raw_file_id": "d2", "file_name": "n", "file_size": "big"}', good % "d3"]), "e/1": "[]",
    }
    for name, text in texts.items():
        (tmp_path / name[0]).mkdir(exist_ok=True)
        (tmp_path / f"{name}.medias.json").write_text(text)
    assert [r.raw_file_id for r in files.read_manifests(spark, str(tmp_path)).collect()] == ["a1", "b1", "b2", "d1"]


def test_a_repeated_attempt_appends_once(tmp_path):
    path = tmp_path / "x.json"
    for name, parts in (("a", ["1", "2"]), ("b", ["3"])):
        for cut in (1, 2):  # the first attempt stops on the way
            file = render.Appender(str(path), name, True)
            file.begin()
            for part in parts[:cut]:
                file.add([part])
    assert json.loads(path.read_text()) == [1, 2, 3]
    text = tmp_path / "x.txt"
    for _ in range(3):
        file = render.Appender(str(text), "c", False)
        file.begin()
        file.add(["line\n"])
    assert text.read_text() == "line\n"


def test_append_reads_only_the_tail(tmp_path):
    path = tmp_path / "big.json"
    path.write_text("[" + ",\n".join(str(i) for i in range(50_000)) + " \n" * 5000 + "]\n")
    render.append_json_array(str(path), ["-1", "-2"])
    assert json.loads(path.read_text()) == [*range(50_000), -1, -2]
    render.write_json_array(str(path), [])
    render.append_json_array(str(path), ["4"])
    assert json.loads(path.read_text()) == [4]


def test_topic_files_by_rising_id(spark, tmp_path):
    rows = spark.createDataFrame([(1, 20, "b"), (1, 3, "a"), (2, 5, None)], TOPICS)
    render.dump_topics(rows, str(tmp_path / "json"), str(tmp_path / "txt"))
    assert list(json.loads((tmp_path / "json/1/topics.json").read_text())) == ["3", "20"]
    assert (tmp_path / "txt/1/topics.txt").read_text() == "3\ta\n20\tb\n"
    read = files.read_topic_files(spark, str(tmp_path / "json/1/topics.json"), str(tmp_path / "txt/none.txt"), 1)
    assert sorted((r.topic_id, r.title) for r in topics.load_topics(read).collect()) == [(3, "a"), (20, "b")]


def test_paging_equals_a_loop_over_pages(spark):
    rng = random.Random(8)
    rows = [(c, i, rng.random() < 0.4) for c in range(12) for i in rng.sample(range(100), rng.randint(0, 30))]
    frame = spark.createDataFrame(rows, "chat_id long, topic_id long, ok boolean")
    for size in (1, 2, 3, 5):
        want = set()
        for c in range(12):
            listed, cursor = sorted((r for r in rows if r[0] == c), key=lambda r: -r[1]), 0
            while page := listed[cursor : cursor + size]:
                valid = [k for k, r in enumerate(page) if r[2]]
                want |= {page[k][:2] for k in valid}
                if not valid or len(page) < size:
                    break
                cursor += valid[-1] + 1
        got = topics.reached_by_paging(frame, "chat_id", ["topic_id"], frame["ok"], size)
        assert {(r.chat_id, r.topic_id) for r in got.collect()} == want


def test_waiting_for_a_busy_source():
    class Busy(Exception):
        pass

    class Gone(Exception):
        pass

    answers, slept = [Busy(), Busy(), 5, Gone(), OSError()], []

    def call():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    run = media.patient(call, Busy, Gone, 30, slept.append)
    assert run() == 5 and slept == [30, 30] and run() is None
    with pytest.raises(OSError):
        run()


def test_tail_comes_in_ascending_order(spark):
    rows = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (1, 6, 3), (1, 6, 0), (2, 1, 4)], "chat_id long, id long, arrival_seq long")
    marks = spark.createDataFrame([(1, 4), (2, None)], "id long, latest_message_id long")
    assert [(r.id, r.arrival_seq) for r in sync.pending(rows, marks).collect()] == [(6, 0), (6, 3), (9, 1)]
