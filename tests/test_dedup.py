"""Repeats within a window of the last original: against a fold in order of time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ordered
from feedloom.operators.dedup import DAY, dedup_24h

START = datetime(2024, 1, 1)
SCHEMA = "feedback_id long, source_type string, masked_text string, ts timestamp"


def fold(rows, window):
    out, last = [], {}
    for i, source, text, t in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        key = source, text.lower() if text is not None else None
        if key in last and t - last[key][2] <= window:
            last[key][3] += 1
        else:
            last[key] = [source, i, t, 0]
            out.append(last[key])
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.select("source_type", "feedback_id", "ts", "duplicate_count").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_keys(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        hot = rng.random() < 0.4
        at = START + timedelta(minutes=rng.choice([0, 1440, 1441, rng.randrange(0, 60 * 24 * 30), 60 * rng.randrange(0, 300)]))
        rows.append((i, "s" if hot else rng.choice(["s", "t", None]), "Hot" if hot else rng.choice(["a", "A", "b", "", None, "hot"]), at))
    rows += [(900, "s", "Hot", None), *rows[:20]]
    assert got(dedup_24h(spark.createDataFrame(rows, SCHEMA).repartition(4))) == fold(rows, timedelta(days=1))


def test_one_key_is_spread(spark):
    """All rows are one key's, many at one time; its chain has some 250 originals."""
    rows = [(i, "s", "x", START + timedelta(hours=i // 4)) for i in range(2500)] + [(5000 + i, "s", "x", START) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(dedup_24h(df, DAY // 10)) == fold(rows, timedelta(days=0.1))
    times = df.select(F.struct("source_type", "masked_text").alias("key"), F.unix_micros("ts").alias("t")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # joins parts of small tables
    try:
        sizes = [r["count"] for r in ordered.in_parts(times, "key", "t").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * times.count() / 4


def test_nothing(spark):
    assert got(dedup_24h(spark.createDataFrame([], SCHEMA))) == []
    assert "Python" not in dedup_24h(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()


def test_orbits(spark):
    links = [(i, i + 3) for i in range(97)] + [(200, 201)]
    marked = ordered.orbits(spark.createDataFrame([(0,), (200,), (300,)], "at long"), spark.createDataFrame(links, "at long, to long"))
    assert sorted(r["at"] for r in marked.collect()) == [*range(0, 100, 3), 200, 201, 300]
