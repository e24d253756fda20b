"""Exactly one copy of each message out of at-least-once deliveries.

A :class:`DeliveryStore` keeps one copy per (chat_id, id) in partitions of id blocks. The partition follows from the
key, so a merge knows which partitions its rows can touch; it looks up in their part of the identifier index which of
them hold ids of the incoming rows, reads only those, picks one winner per id among old and new copies and writes the
partitions anew; one renamed manifest file makes all of them visible at once. Partitions that share no id with the
incoming rows get their rows appended without being read. The number of partitions follows the number of rows: it is
set by the first rows and doubled by a rewrite when the store has outgrown it, so that a merge costs what its own
partitions cost however long the history is.

The copy with the lowest ``arrival_seq`` wins; null comes last, and copies with equal ``arrival_seq`` are taken in the
order of a hash of their other columns. Copies equal in every column are interchangeable: one stays. Rows without
``chat_id`` or ``id`` have no identity; all of them stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.storage import commit_version, delete_path, new_path, newest_version, written

KEY = ("chat_id", "id")
ORDER = "arrival_seq"
KNOWN = "chat_id is not null and id is not null"
#: Rows of a partition: aimed at, and the factor by which a store may outgrow its partitions before it is divided anew.
PARTITION_ROWS, OUTGROWN = 1 << 20, 4
#: Least number of partitions, and tasks that write each.
LEAST_PARTITIONS, TASKS = 8, 2
#: Copies from which a message is thinned out before rows are exchanged.
HOT_COPIES = 1000


def _block(block: int) -> Column:
    return F.floor(F.col("id") / block)


def _partition(partitions: int, block: int) -> Column:
    """Blocks of neighbouring ids of one chat share a partition; hashing the block spreads a large chat.

    It is the hash that ``repartition`` uses, so rows repartitioned by chat and block into a multiple of ``partitions``
    lie in one partition a task. Multiplying the number divides every partition and mixes none.
    """
    return F.pmod(F.hash("chat_id", _block(block)), F.lit(partitions)).cast("int")


def repeated(rows: DataFrame) -> DataFrame:
    """Messages that came more than once, with the lowest ``arrival_seq`` and the number of copies.

    Counted on keys alone in a hash aggregate that combines before the shuffle, so a hot id costs one row per task.
    """
    counted = rows.where(KNOWN).select(*KEY, ORDER).groupBy(*KEY).agg(F.min(ORDER).alias("lowest"), F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")


def removed_copies(rows: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Each copy that is not the first delivery of its message, one row per copy; ``several`` is :func:`repeated`."""
    several = repeated(rows) if several is None else several
    # Only messages with several copies are looked at; AQE splits the join where one has very many.
    found = rows.where(KNOWN).select(*KEY, ORDER).join(several, [*KEY])
    counted = found.groupBy(*KEY, ORDER, "lowest").agg(F.count(F.lit(1)).alias("n"))
    extra = F.when(F.col(ORDER).eqNullSafe(F.col("lowest")), F.col("n") - 1).otherwise(F.col("n"))
    spread = counted.withColumn("extra", extra).where("extra > 0")
    return spread.select(*KEY, ORDER, F.explode(F.sequence(F.lit(1).cast("long"), F.col("extra"))).alias("i")).drop("i")


def _unused(rows: DataFrame, name: str) -> str:
    """A column name that the rows do not have, in any letter case."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _content(rows: DataFrame) -> Column:
    """Tells copies apart that share their place in the order of delivery; maps cannot be hashed and go as JSON."""
    rest = [f for f in rows.schema.fields if f.name not in (*KEY, ORDER)]
    return F.xxhash64(*(F.to_json(F.col(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rest), F.lit(0))


def first_copies(rows: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """One whole row per message, rows without identity untouched.

    Messages that came once pass by. Of the others only the rows with the lowest ``arrival_seq`` are compared.
    """
    several = repeated(rows) if several is None else several
    known, lowest, row = rows.where(KNOWN), _unused(rows, "lowest"), _unused(rows, "row")
    single = known.join(several.select(*KEY), [*KEY], "left_anti")
    first = known.join(several.select(*KEY, F.col("lowest").alias(lowest)), [*KEY]).where(F.col(ORDER).eqNullSafe(F.col(lowest)))
    rest = [c for c in rows.columns if c not in KEY]
    best = first.groupBy(*KEY).agg(F.min_by(F.struct(*rest), _content(rows)).alias(row))
    whole = best.select(*KEY, *(F.col(row).getField(c).alias(c) for c in rest)).select(*rows.columns)
    return single.select(*rows.columns).unionByName(whole).unionByName(rows.where("chat_id is null or id is null"))


def placed_copies(rows: DataFrame, several: DataFrame, partitions: int, block: int, place: str) -> DataFrame:
    """:func:`first_copies` of the rows with identity, with the partition of each as column ``place``, sorted by it.

    One exchange brings the copies of a message and the rows of a partition together. Copies of messages that have very
    many are dropped before it, all but those with the lowest ``arrival_seq``; such messages are few by their number.
    """
    lowest, row, chunk, is_hot = (_unused(rows, name) for name in ("lowest", "row", "chunk", "is_hot"))
    hot = several.where(F.col("copies") > HOT_COPIES).select(*KEY, F.col("lowest").alias(lowest), F.lit(True).alias(is_hot))
    known = rows.where(KNOWN).join(hot, [*KEY], "left")
    known = known.where(F.col(is_hot).isNull() | F.col(ORDER).eqNullSafe(F.col(lowest))).select(*rows.columns)
    spread = known.withColumn(chunk, _block(block)).repartition(TASKS * partitions, "chat_id", chunk)
    # The window needs no other exchange, and beginning with the partition it gives the order in which files are written.
    copies = Window.partitionBy(place, "chat_id", chunk, "id").orderBy(F.col(ORDER).asc_nulls_last(), _content(rows))
    ranked = spread.withColumn(place, _partition(partitions, block)).withColumn(row, F.row_number().over(copies))
    return ranked.where(F.col(row) == 1).select(*rows.columns, place)


class DeliveryStore:
    """Partitioned store of first copies in a folder all executors share.

    ``partitions`` is the number the first rows are divided into (by default their number over ``PARTITION_ROWS``);
    ``block`` is the number of neighbouring ids that stay together. The driver handles lists of partition numbers, one
    for about a million rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, partitions: int | None = None, block: int = 1 << 14) -> None:
        self.spark, self.path = spark, path or new_path(spark, "deliveries")
        self.wanted, self.block = partitions, block

    # -- manifest -------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest committed version: partition to folders of rows and of ids."""
        found = newest_version(self.spark, f"{self.path}/manifest")
        return found or {"version": 0, "partitions": 0, "n_rows": 0, "rows": {}, "ids": {}}

    # -- reading --------------------------------------------------------------------------------------------------

    def _scan(self, manifest: dict, what: str, schema, parts: list[int] | None = None) -> DataFrame:
        named = manifest[what] if parts is None else {p: manifest[what].get(str(p), []) for p in parts}
        folders = sorted({f for fs in named.values() for f in fs})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def rows(self, schema) -> DataFrame:
        """All stored rows."""
        return self._scan(self.manifest(), "rows", schema)

    def affected(self, incoming: DataFrame) -> list[int]:
        """Partitions that hold an id of the incoming rows: those their keys fall into, checked in the identifier index."""
        manifest = self.manifest()
        if not manifest["partitions"]:
            return []
        keys = incoming.where(KNOWN).select(*KEY).distinct()
        place = _partition(manifest["partitions"], self.block).alias("p")
        possible = sorted(p for (p,) in keys.select(place).distinct().collect() if str(p) in manifest["ids"])
        ids = self._scan(manifest, "ids", keys.schema, possible)
        hit = ids.join(keys, [*KEY], "left_semi").select(place).distinct()
        return sorted(p for (p,) in hit.collect())

    # -- writing --------------------------------------------------------------------------------------------------

    def merge(self, incoming: DataFrame) -> DataFrame:
        """Adds incoming rows and returns every copy dropped by this merge, of old and new rows."""
        before = self.manifest()
        parts = self.affected(incoming)
        union = self._scan(before, "rows", incoming.schema, parts).unionByName(incoming)
        several = written(repeated(union), "repeated")
        removed = written(removed_copies(union, several), "removed-copies")
        n_rows = before["n_rows"] + incoming.count() - removed.count()
        if not before["partitions"]:
            before["partitions"] = self.wanted or 1 << (max(LEAST_PARTITIONS, n_rows // PARTITION_ROWS + 1) - 1).bit_length()
        after = self._write(before, before["partitions"], parts, union, several, n_rows)
        if n_rows > OUTGROWN * PARTITION_ROWS * after["partitions"]:
            everything = self._scan(after, "rows", incoming.schema)
            self._write(after, OUTGROWN * after["partitions"], [int(p) for p in after["rows"]], everything, several.limit(0), n_rows)
        return removed

    def _write(self, before: dict, partitions: int, replaced: list[int], rows: DataFrame, several: DataFrame, n_rows: int) -> dict:
        """Writes first copies as the next version, in place of the replaced partitions and beside all others."""
        version, place = before["version"] + 1, _unused(rows, "_p")
        attempt = f"v{version}-{uuid.uuid4().hex[:8]}"
        folder, index = f"{self.path}/rows/{attempt}", f"{self.path}/ids/{attempt}"
        placed = placed_copies(rows, several, partitions, self.block, place)
        placed.write.partitionBy(place).parquet(folder)
        # Rows without identity lie beside the partitions.
        loose = rows.where("chat_id is null or id is null")
        if not loose.isEmpty():
            loose.withColumn(place, F.lit(-1)).write.mode("append").option("partitionOverwriteMode", "static").partitionBy(place).parquet(folder)
        stored = self.spark.read.option("basePath", folder).schema(placed.schema).parquet(folder)
        stored.where(KNOWN).select(*KEY, place).write.partitionBy(place).parquet(index)
        after = {"version": version, "partitions": partitions, "n_rows": n_rows, "rows": dict(before["rows"]), "ids": dict(before["ids"])}
        for what, base in (("rows", folder), ("ids", index)):
            for p in replaced:
                after[what].pop(str(p), None)
            for p in self._written(base, place):
                after[what][str(p)] = [*after[what].get(str(p), []), f"{base}/{place}={p}"]
        commit_version(self.spark, f"{self.path}/manifest", after)
        self._clean(before, after)
        return after

    def _clean(self, *live: dict) -> None:
        """Deletes folders that neither the new version nor the one before it names, so that open readers can finish."""
        jvm, fs = self._fs()
        used = {f for m in live for what in ("rows", "ids") for fs_ in m[what].values() for f in fs_}
        for what in ("rows", "ids"):
            for version in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")):
                base = f"{self.path}/{what}/{version.getPath().getName()}"
                inside = [f"{base}/{s.getPath().getName()}" for s in fs.listStatus(version.getPath()) if s.isDirectory()]
                gone = [f for f in inside if f not in used]
                for f in [base] if len(gone) == len(inside) else gone:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f), True)

    def _written(self, folder: str, place: str) -> list[int]:
        jvm, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        return [int(n[len(place) + 1 :]) for n in names if n.startswith(f"{place}=")]

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def deduplicate(history: DataFrame, incoming: DataFrame, store: DeliveryStore) -> DataFrame:
    """Loads the history into an empty store, merges the incoming rows and returns all copies dropped on the way."""
    return store.merge(history).unionByName(store.merge(incoming))


def kept_copies(history: DataFrame, incoming: DataFrame, store: DeliveryStore) -> DataFrame:
    """The rows of the store after both merges."""
    store.merge(history)
    store.merge(incoming)
    return store.rows(history.schema)
