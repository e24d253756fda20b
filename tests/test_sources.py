"""The paged data source and running aggregates in blocks."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

from chatloom.operators import blocks
from chatloom.plans.queries import queries
from chatloom.sources.paged import HistoryReader, HistorySource, load_history


def history(path, rows=1000, group=100):
    columns = {"chat_id": [i % 7 for i in range(rows)], "id": list(range(rows)), "reply_to_top_message_id": [None] * rows, "arrival_seq": list(range(rows))}
    schema = pa.schema([(c, pa.int64()) for c in columns])
    pq.write_table(pa.table(columns, schema=schema), path, row_group_size=group)
    return str(path)


def test_bounds_skip_row_groups(tmp_path):
    path = history(tmp_path / "h.parquet")
    for filters, groups in (([], 10), ([LessThan(("id",), 150)], 2), ([GreaterThan(("id",), 899)], 1), ([EqualTo(("id",), 555)], 1), ([LessThan(("id",), 0)], 0), ([IsNotNull(("id",))], 10)):
        reader = HistoryReader({"path": path})
        assert list(reader.pushFilters(filters)) == filters
        # Only the tasks open files; what they read is whole row groups that may hold a row.
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == groups * 100


def test_source_equals_a_parquet_scan(spark, tmp_path):
    path = history(tmp_path / "h.parquet")
    spark.dataSource.register(HistorySource)
    read = spark.read.format("chat_history").option("path", path).option("batch_size", "64").load().where("id > 420 and chat_id = 3")
    assert sorted(r.id for r in read.collect()) == [i for i in range(421, 1000) if i % 7 == 3]
    assert spark.read.format("chat_history").option("path", path).load().where("id < 0").count() == 0


def test_whole_history_is_counted(spark, tmp_path):
    history(tmp_path / "messages.parquet")
    got = {tuple(r) for r in queries()["paged_history"](spark, str(tmp_path)).collect()}
    assert got == {(c, len(range(c, 1000, 7)), max(range(c, 1000, 7))) for c in range(7)}


def test_sessions_without_pushed_filters(spark, tmp_path):
    path = history(tmp_path / "h.parquet")
    setting = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    try:
        for value in ("false", "true"):
            spark.conf.set(setting, value)
            assert load_history(spark, path).where("id < 7").count() == 7
    finally:
        spark.conf.set(setting, before)


def test_block_sums_equal_plain_windows(spark):
    random.seed(6)
    rows = [(random.choice([None, 1, 1, 1, 2]), k, random.choice([None, *range(50)])) for k in range(300)]
    frame = spark.createDataFrame(rows, "g long, k long, v long").selectExpr("*", "floor(k / 16) as b")
    for kind, current in (("sum", True), ("max", True), ("min", True), ("max", False)):
        got = {r.k: r.x for r in blocks.running(frame, ("g",), "b", ("k",), kind, frame["v"], "x", current).collect()}
        for g in (None, 1, 2):
            seen = []
            for row in [r for r in rows if r[0] == g]:
                before = [v for v in seen + [row[2]] * current if v is not None]
                seen.append(row[2])
                want = sum(before) if kind == "sum" else {"max": max, "min": min}[kind](before, default=None)
                assert got[row[1]] == want
