"""One order over all rows without one task: range-sorted parts, and what crosses their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.sources.shared import write_and_read


def in_parts(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in range-sorted parts ``_part``, and ``_at``, which rises over all of them.

    The parts are cut by the whole order, so that no value of its first column makes a part large.
    """
    ranged = rows.orderBy(*order)
    return write_and_read(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "parts")


def sum_before(parts: DataFrame, n: Column) -> DataFrame:
    """Adds ``before``, the sum of ``n`` over all earlier rows, to ``in_parts`` rows."""
    sizes = parts.groupBy("_part").agg(F.sum(n).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(first), "_part").withColumn("before", F.col("_first") + F.coalesce(F.sum(n).over(inside), F.lit(0)))


def first_after(rows: DataFrame, later: Column) -> DataFrame:
    """``rows(key, t, at)`` -> (at, to): for each row the first row of its key with t over
    ``later``, a function of t, and of several the least ``at``; rows without one are left out.

    Rows and look-ups are put in one order.  The next row of a look-up stands in its own part, or
    is the first row of a part behind it, of which there is one each.
    """
    asked = rows.select("key", later.alias("t"), F.lit(1).alias("asks"), "at")  # behind rows of the same time
    parts = in_parts(rows.select("key", "t", F.lit(0).alias("asks"), "at").union(asked), "key", "t", "asks", "at")
    row = F.when(F.col("asks") == 0, F.struct("key", "at"))
    back = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = parts.groupBy("_part").agg(F.min_by(row, F.when(F.col("asks") == 0, F.col("_at"))).alias("_first"))
    behind = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = firsts.select("_part", F.last("_first", ignorenulls=True).over(behind).alias("_carried"))
    found = parts.withColumn("_next", F.last(row, ignorenulls=True).over(back)).where("asks = 1").join(F.broadcast(carried), "_part")
    found = found.withColumn("_next", F.coalesce("_next", "_carried"))
    return found.where("_next.key = key").select("at", F.col("_next.at").alias("to"))


def last_until(parts: DataFrame, value: Column) -> DataFrame:
    """Adds ``last`` to ``in_parts`` rows: the last ``value`` that is not null at or before each."""
    forward = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lasts = parts.groupBy("_part").agg(F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = lasts.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    found = parts.withColumn("_inside", F.last(value, ignorenulls=True).over(forward)).join(F.broadcast(carried), "_part")
    return found.withColumn("last", F.coalesce("_inside", "_carried")).drop("_inside", "_carried")


def orbits(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(at) of all that ``roots(at)`` reach over ``links(at, to)``, where every row has one link at
    most and a link leads forward.

    Pointer doubling: links are joined with themselves until none is as long as the longest
    orbit; taken from the longest to the shortest, each doubles what is marked.  Rows that are
    neither a root nor a link's end can't be on an orbit.
    """
    links = write_and_read(links, "links")
    able = roots.select("at").union(links.select("to")).distinct()
    power = write_and_read(links.join(able, "at", "left_semi"), "links")
    powers = []
    while not power.isEmpty():
        powers.append(power)
        double = power.select("at", F.col("to").alias("via")).join(power.withColumnRenamed("at", "via"), "via")
        power = write_and_read(double.select("at", "to"), "links")
    marked = roots.select("at")
    for power in reversed(powers):
        marked = write_and_read(marked.union(power.join(marked, "at", "left_semi").select("to")), "marked")
    return marked
