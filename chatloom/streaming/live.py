"""Live append as a stream into an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from chatloom.operators.archive import KINDS, Archive
from chatloom.schemas import MESSAGES

#: Files of a micro-batch, so that a long history is not taken in at once.
FILES_PER_TRIGGER = 64


def run_live(
    spark: SparkSession, source: str, archive: Archive | None = None, chats: DataFrame | None = None, listed: DataFrame | None = None,
    kinds: tuple[str, ...] = KINDS, schema: StructType = MESSAGES, files_per_trigger: int = FILES_PER_TRIGGER,
) -> Archive:
    """Streams all files of ``source`` into the archive and returns it once they are in.

    The state of a chat is its row in the archive, which is committed with the rows that changed it. The stream's own
    progress lies beside it, so a stream that is stopped and started again repeats at most the batch it was in, and that
    one replaces itself. Marks inside a batch are taken in blocks of arrivals, so a chat that holds most of a batch is
    spread over tasks.
    """
    archive = archive or Archive(spark)
    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        .writeStream.option("checkpointLocation", f"{archive.path}/stream").trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: archive.append(rows, batch, chats, listed, kinds)).start()
    )
    query.awaitTermination()
    return archive
