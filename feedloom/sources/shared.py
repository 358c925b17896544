"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local session that names none gets a
    temporary folder: elsewhere each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/feedback-{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage: a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_shared(path: str, how: str):
    """A file of the shared folder as pyarrow's file systems open it, in a task or on the driver."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^(file:)?/+", "file:///", path)))
    if how == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_file(inner)
