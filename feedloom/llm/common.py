"""Helpers that several corpus operators share: word tables, shared tables, Arrow access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space, so that
#: ``text.translate(WORDS).split()`` yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

#: Words of a text from the first to the one before ``after``.
SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])

#: While a table is written here: what Spark hands to a Python worker at once, rows and bytes, and
#: rows that a scan holds as columns, which are whole texts or lists of all their words.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}
#: Bytes of a row group that a writing task holds in memory.
ROW_GROUP = 16 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests, a laptop) gets a temporary folder; elsewhere
    each executor would write to a disk of its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/feedloom-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> dict[str, str]:
    """From now on plans are made with ``BATCHES`` at most; what was set before."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():  # a limit of 0 or less is none
        now = int(before[k].rstrip("b"))
        spark.conf.set(k, str(min(now, most) if now > 0 else most))
    return before


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost
    executor costs a re-read, not a recomputation.  Python workers get small batches meanwhile."""
    spark = df.sparkSession
    path, before = new_path(spark, name), small_batches(spark)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library gives pages back by itself
    _trim = None


def release() -> None:
    """Gives freed memory back to the system, so that a worker that is reused stays small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """A column in parts, so that only one part's values stand as Python objects at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows)
    release()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for part in slices(column.cast(kind)):
        yield from part.to_pylist()


def collected(parts: Iterator[pa.Array], kind: pa.DataType) -> pa.Array:
    """The parts as one array."""
    return pa.concat_arrays([pa.array([], kind), *parts])


def hashed_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, chosen by hash of the key: a repeatable sample.

    What cannot be among them by a wide margin is dropped where it is, so that tasks do not send
    their own ``rows`` smallest each.
    """
    total, h = df.count(), F.xxhash64(*key)
    if total > 2 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(1.5 * rows / total * (1 << 30)))
    return df.orderBy(h, *key).limit(rows)


def uri(path: str) -> str:
    """A path as pyarrow's file systems take it."""
    path = re.sub(r"^file:/+", "file:///", path)
    return re.sub(r"^s3[an]:", "s3:", path)


def open_shared(path: str, how: str):
    """A file of the shared folder (``file``, ``hdfs``, ``s3``, ``gs``), opened in a task or on the driver."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri(path))
    if how == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_file(inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch made one."""
    one: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if one and a <= one[-1][1]:
            one[-1] = one[-1][0], max(one[-1][1], b)
        else:
            one.append((a, b))
    return one


@F.arrow_udf(T.ArrayType(SPAN))
def merged(spans: pa.Array) -> pa.Array:
    """Spans in order, those that touch made one."""
    out = []
    for row in spans.to_pylist():
        out.append([{"first": a, "after": b} for a, b in joined_spans((x["first"], x["after"]) for x in row or [])])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))


#: DuckDB: a CTE with the 256 steps of CRC-32, and the unsigned CRC-32 of a text's UTF-8 bytes by it.
CRC_STEPS_SQL = """crc_steps as (
  select list(c order by k) as steps from (
    select k, list_reduce(list_prepend(k::ubigint, range(8)::ubigint[]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as k)))"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of ``text``, where ``crc_steps`` is among the tables."""
    octets = f"list_transform(range(1, len(hex({text})) + 1, 2), lambda k: ('0x' || substr(hex({text}), k, 2))::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::bigint + 1])), 4294967295)"
