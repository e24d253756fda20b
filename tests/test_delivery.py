"""Deliveries against brute force, over batches and with odd rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chatloom.operators import delivery
from chatloom.plans.queries import queries
from chatloom.schemas import MESSAGES

SCHEMA = "chat_id long, id long, arrival_seq long, text string"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups[r[:2]].append(r)
    removed = Counter()
    for copies in groups.values():
        copies.sort(key=lambda r: (r[2] is None, r[2] or 0))
        removed.update(r[:3] for r in copies[1:])
    return removed


def test_merges_equal_brute_force(spark):
    random.seed(5)
    rows = [(random.choice([1, 1, 1, 2, 3, None]), random.choice([7] * 5 + list(range(60)) + [None]), i, random.choice("ab")) for i in range(600)]
    random.shuffle(rows)
    store = delivery.DeliveryStore(spark, partitions=5, block=8)
    parts = [rows[:250], rows[250:400], rows[400:401], rows[401:]]
    removed = Counter()
    for part in parts:
        removed.update(tuple(r) for r in store.merge(spark.createDataFrame(part, SCHEMA)).collect())
    assert removed == brute(rows)
    stored = [tuple(r) for r in store.rows(spark.createDataFrame([], SCHEMA).schema).collect()]
    assert Counter(stored) == Counter(rows) - Counter({r: 1 for r in rows if removed[r[:3]]})
    assert store.manifest()["version"] == 4


def test_untouched_partitions_are_not_rewritten(spark):
    store = delivery.DeliveryStore(spark, partitions=8, block=1)
    store.merge(spark.createDataFrame([(1, i, i, "a") for i in range(40)], SCHEMA)).count()
    before = store.manifest()["rows"]
    incoming = spark.createDataFrame([(1, 3, 99, "b")], SCHEMA)
    hit = store.affected(incoming)
    assert len(hit) == 1
    store.merge(incoming).count()
    after = store.manifest()["rows"]
    assert [p for p in before if before[p] != after[p]] == [str(hit[0])]


def test_ties_repeated_and_extra_columns(spark):
    rows = [(1, 1, None, "z"), (1, 1, 5, "b"), (1, 1, 5, "a"), (1, 1, 5, "a"), (2, 2, None, "q"), (2, 2, None, "q")]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", n long, _first long")
    got = Counter(tuple(r) for r in delivery.removed_copies(frame).collect())
    assert got == Counter({(1, 1, 5): 2, (1, 1, None): 1, (2, 2, None): 1})
    assert delivery.first_copies(frame).count() == 2
    assert delivery.first_copies(frame.limit(0)).count() == 0 and delivery.removed_copies(frame.limit(0)).count() == 0


def test_hot_message_in_the_store(spark, monkeypatch):
    """Copies of a hot message are dropped before rows are exchanged; ties, nulls and other messages come out the same."""
    monkeypatch.setattr(delivery, "HOT_COPIES", 3)
    rows = [(1, 7, k % 50 + 1, "a") for k in range(300)] + [(1, 7, None, "n"), (1, 7, 1, "A"), (2, 1, None, "x"), (2, 1, None, "y"), (2, 2, 5, "z"), (2, 2, 4, "w")]
    frame = spark.createDataFrame(rows, SCHEMA)
    placed = delivery.placed_copies(frame, delivery.repeated(frame), 4, 8, "_p").collect()
    plain = delivery.first_copies(frame).collect()
    assert sorted(tuple(r)[:4] for r in placed) == sorted(tuple(r) for r in plain) and len(plain) == 3
    wanted = frame.select("*", delivery._partition(4, 8).alias("_p")).distinct()
    assert {(r.chat_id, r.id, r._p) for r in placed} <= {(r.chat_id, r.id, r._p) for r in wanted.collect()}


def test_hot_identifier(spark):
    frame = spark.range(30_000).selectExpr("1L as chat_id", "if(id % 3 = 0, 7L, id) as id", "id as arrival_seq", "'t' as text")
    assert delivery.removed_copies(frame).count() == 30_000 - frame.select("id").distinct().count()


def test_partitions_follow_the_rows(spark, monkeypatch):
    """A store that has outgrown its partitions is divided anew and keeps every row; old folders are deleted."""
    monkeypatch.setattr(delivery, "PARTITION_ROWS", 10)
    store = delivery.DeliveryStore(spark, block=4)
    store.merge(spark.createDataFrame([(1, i, i, "a") for i in range(50)] + [(None, 1, 1, "n")], SCHEMA))
    assert store.manifest()["partitions"] == 8
    store.merge(spark.createDataFrame([(2, i, 1000 + i, "b") for i in range(400)] + [(1, 3, 2000, "late")], SCHEMA))
    manifest = store.manifest()
    assert manifest["partitions"] == 32 and manifest["n_rows"] == 451
    stored = [tuple(r) for r in store.rows(spark.createDataFrame([], SCHEMA).schema).collect()]
    assert len(stored) == 451 and (1, 3, 3, "a") in stored and (None, 1, 1, "n") in stored
    incoming = spark.createDataFrame([(2, 7, 3000, "c")], SCHEMA)
    hit = store.affected(incoming)
    read = store._scan(manifest, "ids", incoming.select("chat_id", "id").schema, hit).inputFiles()
    assert len(hit) == 1 and len({f.rsplit("/", 1)[0] for f in read}) == 1
    store.merge(incoming)
    store.merge(incoming.withColumn("arrival_seq", F.lit(4000).cast("long")))
    _, fs = store._fs()
    kept = {f for what in ("rows", "ids") for m in (store.manifest(),) for fs_ in m[what].values() for f in fs_}
    assert len(kept) <= 2 * (32 + 1) and store.rows(incoming.schema).count() == 451


def test_merges_with_taken_names_and_empty_batches(spark):
    frame = spark.createDataFrame([(1, 1, 2, "b", 5), (1, 1, 1, "a", 6), (2, 1, 3, "c", 7)], SCHEMA + ", _p int")
    store = delivery.DeliveryStore(spark, partitions=3)
    assert store.merge(frame.limit(0)).count() == 0
    assert [tuple(r) for r in store.merge(frame).collect()] == [(1, 1, 2)]
    assert store.merge(frame.limit(0)).count() == 0
    assert sorted(tuple(r) for r in store.rows(frame.schema).collect()) == [(1, 1, 1, "a", 6), (2, 1, 3, "c", 7)]


def test_whole_messages_come_out_of_the_store(spark, tmp_path):
    def message(i, seq, **more):
        return {f.name: None for f in MESSAGES.fields} | {"chat_id": 1, "id": i, "arrival_seq": seq, "batch_id": seq % 3} | more

    photo = {f: None for f in MESSAGES["photo"].dataType.names} | {"kind": "photo", "file_id": "f", "file_size": 5}
    user = {"id": 9, "first_name": "Ann", "last_name": None, "username": None}
    rows = [
        message(1, 1, photo=photo, from_user=user), message(1, 3, text="late"), message(2, 6, new_chat_title="t", new_chat_members=[user]),
        message(2, 2, pinned_message={"id": 1}), message(3, 4, text="x", batch_id=None),
    ]
    spark.createDataFrame(rows, MESSAGES).write.parquet(str(tmp_path / "messages.parquet"))
    batches = spark.createDataFrame([(0, "backfill", True), (1, "backfill", False), (2, "live", True)], "batch_id long, phase string, committed boolean")
    batches.write.parquet(str(tmp_path / "export_batches.parquet"))
    got = queries()["p5_whole_messages"](spark, str(tmp_path))
    assert got.columns == MESSAGES.names
    assert sorted((r.asDict(True) for r in got.collect()), key=lambda r: r["id"]) == [rows[0], rows[3], rows[4]]
