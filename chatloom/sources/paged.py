"""A Python data source that scans message history by row group with the id bounds pushed into the scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
    LessThanOrEqual,
)

SCHEMA = "chat_id long, id long, reply_to_top_message_id long, arrival_seq long"
OPERATIONS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


#: Bytes of a file that one partition is meant to read.
SPLIT_BYTES = 128 << 20


class Share(InputPartition):
    """Every ``of``-th row group of a file, from the number ``part`` on."""

    def __init__(self, path: str, part: int, of: int) -> None:
        self.path, self.part, self.of = path, part, of


class WholeReader(DataSourceReader):
    """Files are listed on the driver and opened by the tasks. Paths with a scheme go through the file system of that
    scheme."""

    def __init__(self, options: dict) -> None:
        self.path, self.batch, self.bounds = options["path"], int(options.get("batch_size", 1000)), []

    def _may_hold(self, group) -> bool:
        stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for name, operation, value in self.bounds:
            s = stats.get(name)
            if s is None or not s.has_min_max:
                continue
            above, below = (operation == ">" and s.max <= value), (operation == "<" and s.min >= value)
            if above or below or (operation in (">=", "==") and s.max < value) or (operation in ("<=", "==") and s.min > value):
                return False
        return True

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info([path])
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        shares = [(f.path, max(1, -(-f.size // SPLIT_BYTES))) for f in files]
        return [Share(path, part, of) for path, of in shares for part in range(of)]

    def read(self, partition: InputPartition):
        import pyarrow.parquet as pq

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        with self._system()[0].open_input_file(partition.path) as opened:
            file = pq.ParquetFile(opened)
            groups = [g for g in range(partition.part, file.metadata.num_row_groups, partition.of) if self._may_hold(file.metadata.row_group(g))]
            if groups:
                yield from file.iter_batches(batch_size=self.batch, row_groups=groups, columns=columns)


class HistoryReader(WholeReader):
    """Takes bounds on ids over from the query and skips row groups whose statistics exclude them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in OPERATIONS and len(f.attribute) == 1 and f.attribute[0] in ("id", "chat_id"):
                self.bounds.append((f.attribute[0], OPERATIONS[type(f)], f.value))
            yield f  # Spark checks rows again, so a skipped group is all that pushing has to get right


class WholeSource(DataSource):
    """The source for sessions in which filters are not pushed into Python sources."""

    @classmethod
    def name(cls) -> str:
        return "chat_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WholeReader(self.options)


class HistorySource(WholeSource):
    """``spark.read.format("chat_history").option("path", ...).load()`` after registering the class."""

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The history through the source that the session's settings allow."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(HistorySource if pushed else WholeSource)
    return spark.read.format("chat_history").option("path", path).load()
