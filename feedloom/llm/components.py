"""Connected components of a large edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import materialize


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them.  Edges point down."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = edges.join(least, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of ids of one orderable type -> ``(id, component)`` for every id on an edge.

    ``component`` is the smallest id of the component.  Loops and repeated edges are ignored,
    edges with a null end too; no edge gives an empty table.  Each round writes the edges to
    the shared folder; the number of rounds follows the logarithm of the longest path.  All
    steps are joins and grouped minima: a node with very many neighbours is combined before the
    shuffle, and since the minima are written first, the join reads plain shuffles and splits it.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(high.alias("a"), low.alias("b"))
        .distinct(),
        "edges",
    )
    stamp = _stamp(now)
    while stamp[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
