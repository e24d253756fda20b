"""Tables written to the cluster's shared folder, used to cut lineage and to keep results over executor loss."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the setting is absent, a temporary one in local mode, as in tests;
    on a cluster that is an error, as every executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chatloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def restored_key(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Gives the text column ``_k`` its name and type back. Keys pass through pandas as text, as null turns whole
    numbers into floats there."""
    rest = [F.col(c) for c in rows.columns if c != "_k"]
    return rows.select(F.col("_k").cast(kind).alias(key), *rest)


def newest_version(spark: SparkSession, folder: str) -> dict | None:
    """The content of the newest version file of a folder, null if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    numbers = [int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)]
    if not numbers:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{max(numbers)}.json"))
    try:
        return json.loads(str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit_version(spark: SparkSession, folder: str, content: dict) -> None:
    """Makes ``content`` the version that it names, in one rename; older files than the one before it are deleted."""
    jvm, number = spark.sparkContext._jvm, content["version"]
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(f"{number}.json")):
        raise RuntimeError(f"version {number} was committed by another writer")
    attempt = path(f"{number}.{uuid.uuid4().hex}.new")
    out = fs.create(attempt, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(attempt, path(f"{number}.json")):
        raise RuntimeError(f"version {number} was committed by another writer")
    for s in fs.listStatus(path("")):
        name = s.getPath().getName()
        if re.fullmatch(r"\d+\.json", name) and int(name.removesuffix(".json")) < number - 1:
            fs.delete(s.getPath(), False)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`written` or :func:`new_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
