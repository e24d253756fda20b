"""Readers for the table directory and for the files of an archive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom import schemas
from chatloom.operators.state import validate_state
from chatloom.storage import written


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a directory; filters and columns reach the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State rows of ``{"chats": [...]}`` files; missing or differently shaped lists give no rows."""
    files = spark.read.text(path, wholetext=True)
    chats = F.try_variant_get(F.try_parse_json("value"), "$.chats", "variant")
    listed = files.select(chats.alias("c")).where(F.schema_of_variant("c").startswith("ARRAY"))
    return validate_state(listed.select(F.explode(F.from_json(F.to_json("c"), "array<string>")).alias("record")))


def array_prefix(text: str) -> list:
    """The elements of a JSON array up to the first that does not parse."""
    decoder, at, found = json.JSONDecoder(), len(text) - len(text.lstrip()), []
    if text[at : at + 1] != "[":
        return found
    while True:
        at += 1
        at += len(text[at:]) - len(text[at:].lstrip())
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return found
        found.append(value)
        at += len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] != ",":
            return found


def _entry(value) -> tuple | None:
    """The fields of a manifest entry, null where a field has a wrong type."""
    if not isinstance(value, dict):
        return None
    row = tuple(value.get(f.name) for f in schemas.MANIFEST.fields)
    right = (isinstance(row[0], str), isinstance(row[1], str | None), type(row[2]) in (int, type(None)), isinstance(row[3], str | None))
    return row if all(right) else None


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all ``*.medias.json`` below ``path`` with the file they are from, in the order of files and entries.

    Of a file that does not parse, or holds an entry of a wrong shape, the entries before the fault are kept; whole files
    are read by Spark, only the broken ones pass through Python. Entries without a file id are left out.
    """
    corrupt = "_corrupt"
    schema = T.StructType([*schemas.MANIFEST.fields, T.StructField(corrupt, T.StringType())])
    rows = (
        spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.medias.json").option("columnNameOfCorruptRecord", corrupt).json(path)
    ).select("*", F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("_at"))
    # Parsed once; a file is one task's, so the numbers rise with its entries.
    rows = written(rows, "manifests-read")
    broken = rows.where(F.col(corrupt).isNotNull()).groupBy("source").agg(F.max(corrupt).alias("text"))
    names = [f.name for f in schemas.MANIFEST.fields]

    def salvage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for source, text in zip(frame["source"], frame["text"], strict=True):
                for at, value in enumerate(array_prefix(text)):
                    entry = _entry(value)
                    if entry is None:
                        break
                    found.append((*entry[:2], None if entry[2] is None else str(entry[2]), entry[3], source, at))
            yield pd.DataFrame(found, columns=[*names, "source", "_at"])

    saved = broken.mapInPandas(salvage, "raw_file_id string, file_name string, file_size string, file_type string, source string, _at long")
    saved = saved.withColumn("file_size", F.col("file_size").cast("long"))
    whole = rows.where(F.col(corrupt).isNull()).join(broken.select("source"), "source", "left_anti").select(*saved.columns)
    return whole.unionByName(saved).where("raw_file_id is not null").orderBy("source", "_at").drop("_at")


def read_topic_files(spark: SparkSession, json_path: str, txt_path: str, chat_id: int) -> DataFrame:
    """One row (chat_id, json, txt) for :func:`chatloom.operators.topics.load_topics`; a missing file is null, any
    other fault an error."""
    jvm = spark.sparkContext._jvm

    def content(path: str) -> str | None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return None
        return spark.read.text(path, wholetext=True).agg(F.max("value")).first()[0]

    return spark.createDataFrame([(chat_id, content(json_path), content(txt_path))], "chat_id long, json string, txt string")


def tag_of(payload: Column) -> Column:
    """Type tag ``_`` of a JSON object, null if it is missing or no string."""
    tag = F.try_variant_get(F.try_parse_json(payload), "$._", "variant")
    return F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get(tag, "$", "string"))


def enum_member(value: Column) -> Column:
    """``TypeName.MEMBER`` gives ``MEMBER``: what follows the first dot."""
    return F.regexp_replace(value, r"^[^.]*\.", "")


#: Types that exported objects are decoded to, by tag.
TAGGED_TYPES = {
    "Message": schemas.MESSAGES, "User": schemas.USER, "Chat": schemas.CHATS,
    "ForumTopic": T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())]),
}


def load_tagged(rows: DataFrame, types: dict[str, str | T.StructType] | None = None, payload: str = "payload", strict: bool = True) -> DataFrame:
    """Decodes each JSON object by its tag into one struct column per type of ``types`` (tag to schema).

    Missing and unknown tags raise an error if ``strict``, else the row is dropped.
    """
    types = TAGGED_TYPES if types is None else types
    tag = tag_of(F.col(payload))
    tagged = rows.withColumn("tag", tag)
    known = F.coalesce(F.col("tag").isin(*types), F.lit(False))
    if strict:
        problem = F.concat(F.lit("no type for tag "), F.coalesce("tag", F.lit("(none)")))
        tagged = tagged.withColumn("tag", F.when(known, F.col("tag")).otherwise(F.raise_error(problem).cast("string")))
    else:
        tagged = tagged.where(known)
    decoded = [F.when(F.col("tag") == name, F.from_json(payload, ddl)).alias(name) for name, ddl in types.items()]
    return tagged.select(*rows.columns, "tag", *decoded)
