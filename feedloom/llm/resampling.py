"""Target-distribution importance resampling with exact ranks.

A document's hashed word runs are weighed by how much more frequent their bucket is in a target
corpus than in all documents; noise that follows from the id alone turns the draw of the highest
scores into a sample without replacement.  The ranks come from parallel sorting by regular
sampling: locally sorted runs give regular splitters, each segment between two splitters is
merged by itself, and the segments' prefix counts make positions ranks.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import CRC_STEPS_SQL, WORDS, crc_sql, materialize, release, table, utf8

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Rows that the runs give at most to find splitters, however many documents there are.
SAMPLES = 1 << 16


def features(text: bytes | None, longest: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the CRC-32 of each run of 1 to ``longest`` of them."""
    words = (text or b"").translate(WORDS).split()
    runs: list[bytes] = words
    for k in range(2, longest + 1):
        runs = runs + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all of ``docs(text)`` by bucket.  A task adds its texts up in one array, so at
    most ``buckets`` rows a task are shuffled and ``buckets`` rows reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                total += np.bincount(features(text, longest)[1] % buckets, minlength=buckets)
        (some,) = np.nonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the add-one shares' ratio, for each bucket."""
    every, wanted, k = float(source.sum()), float(target.sum()), float(len(source))
    ratio = ((t + 1.0) * (every + k) / ((s + 1.0) * (wanted + k)) for s, t in zip(source.tolist(), target.tolist()))
    return np.fromiter((math.floor(1000 * math.log(x)) for x in ratio), np.int64, len(source))


def importance_scores(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_words, n_features, weight, score), no texts.

    The weight is the floored mean of the features' gains, 0 without features (null and empty
    texts).  The noise hashes ``seed:doc_id``; a null id counts as an empty one.
    """
    spark, buckets = docs.sparkSession, len(gains)
    shared = spark.sparkContext.broadcast(gains)  # one number a bucket

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                words, found = features(text, longest)
                rows.append((words, len(found), int(shared.value[found % buckets].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    kind = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return docs.select("doc_id", "text").mapInArrow(weigh, kind).withColumn("score", F.col("weight") + noise)


def exact_ranks(rows: DataFrame, most: int, segments: int) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, ... by falling ``score`` and rising ``doc_id`` (null last) over all
    ``rows(score, doc_id, ...)``, null beyond ``most``.

    Every row's run is sorted where it is and written.  Each run gives every n-th of its rows, at
    most ``SAMPLES`` and one a run together; regular ones of these, sorted, split the order in
    segments.  Equal scores are split by id, so no score makes a segment large; rows that are equal
    in both are one segment's, in any order.  Segments wholly beyond ``most`` are not exchanged.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = materialize(rows.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "runs")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)  # position in the run; the run's number stands above
    step = max(1, math.ceil(runs.count() / SAMPLES))
    picked = runs.where((inside + F.shiftright("_at", 33)) % step == 0).select("score", "doc_id")
    regular = sorted(_key(*r) for r in picked.collect())
    splitters = [regular[len(regular) * k // segments] for k in range(1, segments)] if regular else []

    @F.arrow_udf(T.IntegerType())
    def segment_of(score: pa.Array, doc_id: pa.Array) -> pa.Array:
        return pa.array([bisect_left(splitters, _key(s, i)) for s, i in zip(score.to_pylist(), doc_id.to_pylist())], pa.int32())

    cut = materialize(runs.drop("_at").withColumn("_segment", segment_of("score", "doc_id")), "segments")
    before, reached, at = {}, 0, 0
    for segment, n in sorted(cut.groupBy("_segment").count().collect()):
        before[segment], at = at, at + n
        reached = segment if before[segment] < most else reached
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_segment int, _before long")
    place = F.row_number().over(Window.partitionBy("_segment").orderBy(*order))
    merged = (
        cut.where(F.col("_segment") <= reached)
        .repartitionById(segments, "_segment")
        .withColumn("_place", place)
        .join(F.broadcast(offsets), "_segment")  # a row a segment
        .withColumn("rank", F.col("_before") + F.col("_place"))
        .withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    )
    beyond = cut.where(F.col("_segment") > reached).withColumn("rank", F.lit(None).cast("long"))
    return merged.drop("_segment", "_before", "_place").unionByName(beyond.drop("_segment"))


def _key(score: int, doc_id) -> tuple:
    return -score, doc_id is None, 0 if doc_id is None else doc_id


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as (doc_id, n_words, n_features, weight, score, rank).

    Of the rows with ``least_words`` words, ``percent`` % are drawn and have a rank.  Repeated rows
    are drawn each; null and empty texts, and a target without words, are no special case: what
    has no features weighs 0, an empty table gives an empty one.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = materialize(importance_scores(docs, gains, longest, seed), "scores")
    able = F.col("n_words") >= least_words
    drawable = scored.where(able)
    segments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = exact_ranks(drawable, percent * drawable.count() // 100, segments)
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; where an id is repeated, all its rows once one
    is drawn.  The ids travel, and ``docs`` only as Spark needs for a semi join."""
    drawn = importance_ranks(docs, target, **options).where("rank is not null").select("doc_id")
    return docs.join(drawn, "doc_id", "left_semi")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
with {CRC_STEPS_SQL}, d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as g
  from benchmark
), dw as (
  select doc_id, g, count(*) as n from (select doc_id, unnest(w) as g from d) group by all
), hashed as (
  select g, {crc_sql("g")} % {BUCKETS} as k from (select g from dw union select g from b), crc_steps
), s as (
  select k, sum(n) as s from dw join hashed using (g) group by k
), t as (
  select k, count(*) as t from b join hashed using (g) group by k
), total as (
  select (select sum(s) from s)::double as big_s, coalesce((select sum(t) from t), 0)::double as big_t
), gains as (
  select k, floor(1000 * ln((coalesce(t, 0)::double + 1) * (big_s + {BUCKETS}) / ((s::double + 1) * (big_t + {BUCKETS}))))::bigint as gain
  from s left join t using (k), total
), weights as (
  select doc_id, floor(sum(n * gain)::double / sum(n))::bigint as weight from dw join hashed using (g) join gains using (k) group by doc_id
), scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::ubigint::double + 0.5) / 4294967296)))::bigint as score
  from d left join weights using (doc_id)
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= {LEAST_WORDS}
)
select s.doc_id, s.n_features, s.weight, s.score, case when rank <= {PERCENT} * n // 100 then rank end as rank
from scored s left join ranked r on r.doc_id = s.doc_id
"""
