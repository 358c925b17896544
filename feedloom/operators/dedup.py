"""Repeated messages within a time window of the last original."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ordered import first_after, in_parts, orbits, sum_before
from feedloom.sources.shared import write_and_read

DAY = 86_400_000_000


def dedup_24h(rows: DataFrame, window_us: int = DAY) -> DataFrame:
    """``rows(feedback_id, source_type, masked_text, ts)`` -> the originals with
    ``duplicate_count``.

    The first message of a key (source and lower-cased text) is an original; later ones within
    the window *of the original* are its duplicates, and the first beyond it is the next original.
    Messages of one time are one row, their smallest id's; each links to the key's first row
    beyond its window, and the originals are the orbits of the keys' first rows.  All is joins and
    range-sorted parts, so a key of any size is dealt over all tasks.  Nulls are a source and a
    text of their own; rows without a time are left out.
    """
    key = F.struct("source_type", F.md5(F.lower("masked_text")).alias("text_key"))
    keyed = rows.where("ts is not null").select(key.alias("key"), F.unix_micros("ts").alias("t"), "feedback_id")
    times = keyed.groupBy("key", "t").agg(F.min("feedback_id").alias("feedback_id"), F.count("*").alias("n"))
    placed = sum_before(in_parts(times, "key", "t"), F.col("n")).withColumn("at", F.col("before"))
    placed = write_and_read(placed.select("key", "t", "feedback_id", "n", "at"), "times")
    ends = placed.groupBy("key").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    marked = orbits(ends, first_after(placed.select("key", "t", "at"), F.col("t") + window_us))
    originals = write_and_read(placed.join(marked, "at", "left_semi"), "originals")
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at"))  # a window apart each
    count = F.coalesce(following, F.col("end")) - F.col("at") - 1
    return originals.join(ends.select("key", "end"), "key").select(
        "key.source_type", "feedback_id", F.timestamp_micros("t").alias("ts"), count.alias("duplicate_count")
    )
