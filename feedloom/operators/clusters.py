"""Groups of similar feedback: pairs, single-linkage components, labels, priorities, and
leader clustering in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from feedloom.functions.text import bucket_lists, tokenize
from feedloom.operators.similarity import pairs_over
from feedloom.sources.shared import write_and_read


def bucket_vectors(texts: DataFrame, buckets: int = 256) -> DataFrame:
    """``texts(id, text)`` -> (id, tf): sparse token counts as sorted (bucket, count) pairs."""
    return texts.select("id", bucket_lists(F.col("text"), buckets).alias("tf"))


def similarity_pairs(texts: DataFrame, threshold: float, buckets: int = 256, forest: bool = False) -> DataFrame:
    """Pairs (a, b, cosine) of representatives with cosine at least ``threshold``.

    Texts with equal counts are one representative, their smallest id; the rest follows from
    ``same_vector``.  Texts without tokens are on no pair.  With ``forest`` only so many pairs that
    the components are the same.
    """
    _, reps = with_representatives(texts, buckets)
    return pairs_of(reps, threshold, buckets, forest)


def pairs_of(reps: DataFrame, threshold: float, buckets: int, forest: bool) -> DataFrame:
    """``similarity_pairs`` of the representatives ``reps(tf, rep)``."""
    kept = write_and_read(reps.where(F.size("tf") > 0).dropDuplicates(["rep"]), "vectors")
    return pairs_over(kept, threshold, buckets, forest=True) if forest else pairs_over(kept, threshold, buckets)


def same_vector(texts: DataFrame, buckets: int = 256) -> DataFrame:
    """(id, rep, tf): each text with the smallest id of equal token counts.  Texts without tokens
    are all alike, and like nothing else."""
    vectors, reps = with_representatives(texts, buckets)
    return vectors.join(reps, "tf").select("id", "rep", "tf")


def with_representatives(texts: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(id, tf) of all texts, and (tf, rep) of all different counts with their smallest id.  Both are
    written, so that texts are read and cut once, and the join of the two reads plain shuffles and
    splits a frequent vector."""
    vectors = write_and_read(bucket_vectors(texts, buckets), "bucket-vectors")
    return vectors, write_and_read(vectors.groupBy("tf").agg(F.min("id").alias("rep")), "same-vector")


def components(pairs: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of the ids on pairs; component is the smallest id reachable.

    Every id keeps links to smaller ids only.  A round first hangs an id's larger neighbours on its
    smallest neighbour, then its smaller ones on the smallest of them, until all links lead to
    components' smallest ids; long chains shrink by half or more a round.  Each round is written
    to the shared folder; running out of rounds is an error, never a partial result.
    """
    links = pairs.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).where("big <> small")
    links = write_and_read(links.distinct(), "links")
    for _ in range(most_rounds):
        around = links.select(F.col("big").alias("id"), F.col("small").alias("near")).union(links.select("small", "big"))
        least = write_and_read(around.groupBy("id").agg(F.least(F.min("near"), F.first("id")).alias("least")), "least")
        hung = around.where("near > id").join(least, "id").select(F.col("near").alias("big"), F.col("least").alias("small")).distinct()
        hung = write_and_read(hung, "links")
        roots = write_and_read(hung.groupBy("big").agg(F.min("small").alias("root")), "roots")
        moved = write_and_read(hung.join(roots, "big").where("small <> root").select(F.col("small").alias("big"), F.col("root").alias("small")), "moved")
        after = write_and_read(moved.union(roots.select("big", "root")).distinct(), "links")
        if moved.isEmpty() and after.select("small").join(after.select(F.col("big").alias("small")), "small", "left_semi").isEmpty():
            return after.select(F.col("big").alias("id"), F.col("small").alias("component")).union(after.select("small", "small").distinct())
        links = after
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def single_linkage_clusters(texts: DataFrame, threshold: float, buckets: int = 256) -> DataFrame:
    """(id, component): a covering partition of ``texts(id, text)``; component is the smallest id.

    At a threshold of 0 or less all texts are one group.
    """
    if threshold <= 0:
        least = texts.agg(F.min("id").alias("component"))
        return texts.select("id").crossJoin(F.broadcast(least))  # one row
    vectors, reps = with_representatives(texts, buckets)
    same = vectors.join(reps, "tf").select("id", "rep")
    linked = components(pairs_of(reps, threshold, buckets, forest=True))
    return same.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))


def cluster_label(members: DataFrame, most: int = 61, size: int = 120) -> DataFrame:
    """``members(component, id, text)`` -> (component, label): tokens by frequency and name, cut;
    else the first text that is not blank; else the first id."""
    tokens = members.select("component", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("component", "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("component").orderBy(F.desc("n"), "token")
    top = tokens.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    words = top.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("r", "token"))).alias("w"))
    joined = words.select("component", F.rtrim(F.substring(F.array_join(F.transform("w", lambda x: x.token), " "), 1, size)).alias("label"))
    blank = F.length(F.trim("text")) > 0
    other = members.groupBy("component").agg(F.min_by(F.when(blank, F.col("text")), F.when(blank, F.col("id"))).alias("t"), F.min("id").cast("string").alias("i"))
    return other.join(joined, "component", "left").select("component", F.coalesce("label", F.substring("t", 1, size), "i").alias("label"))


def cluster_factors(members: DataFrame, insights: DataFrame) -> DataFrame:
    """``members(cluster_id, feedback_id)``: sum of severity, size (members without insight
    count) and negative members."""
    joined = members.join(insights.select("feedback_id", "severity_score", "sentiment"), "feedback_id", "left")
    return joined.groupBy("cluster_id").agg(
        F.coalesce(F.sum("severity_score"), F.lit(0).cast("long")).alias("severity_sum"),
        F.count("*").alias("n_members"),
        F.count_if(F.col("sentiment") == "negative").alias("n_negative"),
    )


def cluster_priority(severity: Column, size: Column, negative: Column, weights: tuple[float, float, float] = (2.0, 1.0, 3.0)) -> Column:
    return F.greatest(F.lit(0.0), severity * weights[0] + size * weights[1] + negative * weights[2])


def cluster_rank(clusters: DataFrame) -> DataFrame:
    """Position by priority, size and label: numbers in parts of a range sort, then added up, so
    that no task gets all rows."""
    ordered = clusters.orderBy(F.desc("priority"), F.desc("n_members"), "label", "cluster_id")
    numbered = write_and_read(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "rank")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a row a part
    inside = Window.partitionBy("_part").orderBy("_at")
    return numbered.join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + F.row_number().over(inside)).drop("_part", "_at", "_first")


def cluster_numbering(labels: DataFrame) -> DataFrame:
    """``labels(pos, component)``: cluster-k by smallest position."""
    firsts = labels.groupBy("component").agg(F.min("pos").alias("first"), F.count("*").alias("n_members"))
    ranked = cluster_rank(firsts.select(F.col("component").alias("cluster_id"), (-F.col("first")).alias("priority"), F.lit(0).alias("n_members"), F.lit("").alias("label")))
    return ranked.select(F.col("cluster_id").alias("component"), F.concat(F.lit("cluster-"), F.col("rank").cast("string")).alias("name"))


def cluster_volume_update(clusters: DataFrame, assigned: DataFrame, upgrade_over: int = 20, refresh: float = 0.2) -> DataFrame:
    """Clusters with assignments counted in: volume, last time seen, priority upgrade and, if the
    volume grew enough, a new summary."""
    got = assigned.groupBy("cluster_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    volume = F.col("volume_count") + F.coalesce("_n", F.lit(0))
    raised = (volume > upgrade_over) & F.col("priority_level").isin("low", "medium")
    grown = F.coalesce("_n", F.lit(0)) > F.col("volume_count") * refresh
    summary = F.concat(F.lit("Cluster of "), volume.cast("string"), F.lit(" feedback items about "), F.col("theme"))
    return clusters.join(got, "cluster_id", "left").select(
        "cluster_id",
        "theme",
        volume.alias("volume_count"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"),
        F.when(raised, "high").otherwise(F.col("priority_level")).alias("priority_level"),
        F.when(grown, summary).otherwise(F.col("cluster_summary")).alias("cluster_summary"),
    )


WEIGHTS, JOIN_OVER, GEO_KM = (0.5, 0.3, 0.2), 0.7, 50.0
#: Scores that a task keeps, and what stands for no cluster.
KEPT_SCORES, NONE = 4_000_000, np.iinfo(np.int64).max
#: Kinds that may stand without clusters before they are numbered anew: 2 kB each.
MOST_KINDS = 2048


def _counts(text: str) -> dict[str, int]:
    import re

    out: dict[str, int] = {}
    for t in re.findall("[A-Za-z0-9]+", text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def _bucketed(text: str, buckets: int = 256) -> dict[int, float]:
    out: dict[int, float] = {}
    for t, n in _counts(text or "").items():
        h = 2166136261
        for b in t.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out[h % buckets] = out.get(h % buckets, 0) + n
    return out


def _similar(a: dict[int, float], b: dict[int, float]) -> float:
    if not a or not b:
        return float(not a and not b)
    norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return min(1.0, sum(x * b.get(k, 0.0) for k, x in a.items()) / norm)


def sentence(volume: int, theme: str) -> str:
    return f"Cluster of {volume} feedback items about {theme}"


class Leader:
    """Clusters of one theme, fed in order of arrival; ``keep`` takes up those kept from before, in
    order of birth.  One that was idle for over ``idle_us`` takes no record.  With ``lone`` no record
    is like a summary sentence, so a cluster takes one more record at most and then leaves the list.

    Clusters of one vector and place are a kind, and of a kind the oldest takes the record: a record
    is compared with kinds, of which there are few where texts repeat or are summary sentences, and
    its scores with those that have clusters are kept for the next record of its text and place.
    """

    def __init__(self, theme: str, buckets: int = 256, idle_us: int | None = None, lone: bool = False):
        self.theme, self.buckets, self.idle, self.lone = theme, buckets, idle_us, lone
        self.clusters: dict[int, dict] = {}  # by number of birth
        self.born = 0
        self.vectors: dict[str, tuple] = {}
        self._no_kinds()

    def _no_kinds(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.waiting: list[list[int]] = []  # a heap of clusters for each kind
        self.unit, self.place = np.zeros((self.buckets, 64)), np.full((64, 2), np.nan)  # a row a bucket
        self.oldest = np.full(64, NONE)
        self.known: dict[tuple, np.ndarray] = {}
        self.held = 0

    def keep(self, c: dict) -> None:
        """Takes a cluster up behind the others."""
        self.clusters[self.born] = c
        self._wait(self.born)
        self.born += 1

    def _wait(self, number: int) -> None:
        c = self.clusters[number]
        key = c["vector"], c["place"]
        if key not in self.kinds:
            k = self.kinds[key] = len(self.waiting)
            self.waiting.append([])
            if k == len(self.oldest):
                self.unit, self.place = np.hstack([self.unit, np.zeros_like(self.unit)]), np.vstack([self.place, np.full_like(self.place, np.nan)])
                self.oldest = np.concatenate([self.oldest, np.full_like(self.oldest, NONE)])
            self.unit[:, k] = self._unit(c["vector"])
            if c["place"]:
                self.place[k] = c["place"]
        k = self.kinds[key]
        heappush(self.waiting[k], number)
        self.oldest[k] = self.waiting[k][0]

    def _leave(self, k: int) -> None:
        """Takes the oldest cluster of a kind out of it."""
        heappop(self.waiting[k])
        self.oldest[k] = self.waiting[k][0] if self.waiting[k] else NONE

    def _tidy(self) -> None:
        """Numbers kinds anew when most have no clusters any more; scores are forgotten then."""
        n = len(self.waiting)
        if n > MOST_KINDS and 2 * np.count_nonzero(self.oldest[:n] != NONE) < n:
            numbers = sorted(x for heap in self.waiting for x in heap)
            self._no_kinds()
            for x in numbers:
                self._wait(x)

    def _unit(self, counts: tuple) -> np.ndarray:
        v = np.zeros(self.buckets)
        for b, n in counts:
            v[b] = n
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def vector(self, text: str) -> tuple:
        if text not in self.vectors:
            if len(self.vectors) > 10_000:
                self.vectors.clear()
            self.vectors[text] = tuple(sorted(_bucketed(text).items()))
        return self.vectors[text]

    def _scores(self, vector: tuple, place: tuple[float, float] | None, live: np.ndarray) -> np.ndarray:
        """With the kinds ``live``.  What is not known yet is worked out and kept: for a text and place
        that comes again with all kinds at once."""
        got = self.known.get((vector, place))
        again = got is not None
        if got is None or len(got) < len(self.oldest):
            if self.held > KEPT_SCORES:
                self.known, self.held, got = {}, 0, None
            before = np.zeros(0) if got is None else got
            got = self.known[vector, place] = np.concatenate([before, np.full(len(self.oldest) - len(before), np.nan)])
            self.held += len(got) - len(before)
        new = live[np.isnan(got[live])]
        if len(new):
            new = np.flatnonzero(np.isnan(got[: len(self.waiting)])) if again else new
            got[new] = self._worked_out(vector, place, new)
        return got[live]

    def _worked_out(self, vector: tuple, place: tuple[float, float] | None, kinds: np.ndarray) -> np.ndarray:
        v = self._unit(vector)
        cosine = np.zeros(len(kinds))
        for b in np.flatnonzero(v):  # one by one, so that a sum does not depend on how many kinds there are
            cosine += v[b] * self.unit[b, kinds]
        cosine = np.minimum(1.0, cosine) if v.any() else (~self.unit[:, kinds].any(axis=0)).astype(float)
        base = WEIGHTS[0] * cosine + WEIGHTS[1]
        score = base / (WEIGHTS[0] + WEIGHTS[1])
        if place:
            lat, lon = np.radians(self.place[kinds]).T
            a, b = np.radians(place)
            h = np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2
            km = 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
            score = np.where(np.isnan(km), score, base + WEIGHTS[2] * np.maximum(0.0, 1 - km / GEO_KM))
        return score

    def _best(self, vector: tuple, place: tuple[float, float] | None, t: int) -> int | None:
        """The kind whose oldest cluster takes the record: the oldest of the best scores."""
        self._tidy()
        live = np.flatnonzero(self.oldest[: len(self.waiting)] != NONE)
        score = self._scores(vector, place, live)
        while len(live):
            best = score.max()
            if not best > JOIN_OVER:
                return None
            k = live[score == best]
            k = int(k[np.argmin(self.oldest[k])])
            if self.idle is None or t - self.clusters[self.waiting[k][0]]["seen"] <= self.idle:
                return k
            self._leave(k)  # times only grow, so it is idle from here on
            left = self.oldest[live] != NONE
            live, score = live[left], score[left]
        return None

    def assign(self, feedback_id: int, text: str, place: tuple[float, float] | None, t: int = 0) -> str:
        vector = self.vector(text)
        k = self._best(vector, place, t)
        if k is None:
            self.keep({"cluster_id": f"{self.theme}:{feedback_id}", "vector": vector, "place": place, "volume": 1, "summarised": 1, "born": t, "seen": t, "changed": True})
            return f"{self.theme}:{feedback_id}"
        number = self.waiting[k][0]
        c = self.clusters[number]
        c["volume"], c["seen"], c["changed"] = c["volume"] + 1, max(c["seen"], t), True
        if (c["volume"] - c["summarised"]) / c["summarised"] > 0.2:
            self._leave(k)
            c["summarised"] = c["volume"]
            if not self.lone:
                c["vector"] = self.vector(sentence(c["volume"], self.theme))
                self._wait(number)
        return c["cluster_id"]

    def taken(self, all_of_them: bool = False) -> list[dict]:
        """Clusters that a record changed; before the end only those that can't change any more,
        which are let go."""
        if all_of_them:
            done = list(self.clusters)
        else:
            done = [x for x, c in self.clusters.items() if c["volume"] > 1] if self.lone else []
        return [c for c in map(self.clusters.pop, done) if c["changed"]]


FOLDED = "feedback_id long, theme string, cluster_id string, born long, vector array<struct<bucket: int, n: double>>, latitude double, longitude double, volume long, summarised long, seen long"


def fold_clusters(rows: DataFrame, known: DataFrame | None = None, idle_days: int | None = None) -> DataFrame:
    """``rows(feedback_id, theme, ts, text, latitude, longitude, part, lone)`` in (time, id) order of
    each part of a theme through its clusters, those of ``known`` (with ``part`` and ``lone``) first:
    a row (feedback_id, theme, cluster_id) a record, and, with ``known``, without feedback_id each
    cluster that a record changed.

    Spark sorts; a task holds one part's clusters that may still take records, not the records.
    Rows without theme or time are left out.  Parts of a theme have nothing to do with each other,
    ``lone`` is what ``Leader`` takes it for.  A cluster of over one record has no ``vector``, since
    it follows from ``summarised`` and the theme.
    """
    idle = None if idle_days is None else idle_days * 86_400_000_000
    asked = known is not None
    columns = ["theme", "part", "lone", "t", "feedback_id", "text", "latitude", "longitude", "c"]
    records = rows.where("theme is not null and ts is not null").select("theme", "part", "lone", F.unix_micros("ts").alias("t"), "feedback_id", "text", F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    kind = "struct<cluster_id: string, vector: array<struct<bucket: int, n: double>>, volume: bigint, summarised: bigint, seen: bigint>"
    all_rows = records.withColumn("c", F.lit(None).cast(kind)).select(columns)
    if asked:
        cluster = F.struct("cluster_id", "vector", "volume", "summarised", "seen").cast(kind)
        old = known.select("theme", "part", "lone", F.col("born").alias("t"), F.lit(None).cast("long").alias("feedback_id"), F.lit(None).cast("string").alias("text"), "latitude", "longitude", cluster.alias("c"))
        all_rows = all_rows.union(old.select(columns))
    first = F.when(F.col("c").isNotNull(), 0).otherwise(1)
    number = F.element_at(F.split("c.cluster_id", ":"), -1).cast("long")
    ordered = all_rows.withColumns({"_first": first, "_n": F.coalesce(number, F.col("feedback_id"))}).repartition("theme", "part").sortWithinPartitions("theme", "part", "_first", "t", "_n").drop("_first", "_n")
    schema = to_arrow_schema(_parse_datatype_string(FOLDED))

    def stored(theme: str, clusters: list[dict]) -> pa.RecordBatch:
        out = []
        for c in clusters:
            lat, lon = c["place"] or (None, None)
            vector = None if c["volume"] > 1 else [{"bucket": b, "n": float(n)} for b, n in c["vector"]]
            out.append({"theme": theme, **{k: c[k] for k in ("cluster_id", "born", "volume", "summarised", "seen")}, "vector": vector, "latitude": lat, "longitude": lon})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: Leader | None = None
        now = None
        for batch in batches:
            ids, themes, assigned = [], [], []
            for theme, part, lone, t, feedback_id, text, lat, lon, c in zip(*(batch.column(x).to_pylist() for x in columns)):
                if now != (theme, part):
                    if leader and asked:
                        yield stored(leader.theme, leader.taken(True))
                    leader, now = Leader(theme, idle_us=idle, lone=lone), (theme, part)
                place = None if lat is None or lon is None else (lat, lon)
                if c:
                    vector = leader.vector(sentence(c["summarised"], theme)) if c["volume"] > 1 else tuple((x["bucket"], x["n"]) for x in c["vector"])
                    leader.keep({**c, "vector": vector, "place": place, "born": t, "changed": False})
                    continue
                ids.append(feedback_id)
                themes.append(theme)
                assigned.append(leader.assign(feedback_id, text or "", place, t))
            out = {"feedback_id": ids, "theme": themes, "cluster_id": assigned}
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else pa.nulls(len(ids), f.type) for f in schema], schema=schema)
            if leader:
                done = leader.taken()
                if asked and done:
                    yield stored(leader.theme, done)
        if leader and asked:
            yield stored(leader.theme, leader.taken(True))

    return ordered.mapInArrow(run, FOLDED)


def summary_volumes(most: int) -> list[int]:
    """Volumes up to ``most`` and one more at which a growing cluster gets a new summary sentence."""
    out, volume = [], 1
    while volume <= most:
        volume += next(k for k in range(1, volume + 1) if k / volume > 0.2)
        out.append(volume)
    return out


def apart(rows: DataFrame) -> DataFrame:
    """Adds ``part`` and ``lone`` for ``fold_clusters``, as ``apart_from`` finds them."""
    return apart_from(rows, None)[0]


def apart_from(rows: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Adds ``part`` and ``lone`` for ``fold_clusters``: parts of a theme whose records can't join
    each other's clusters; and the clusters of ``known`` that a record may join, with theirs.

    A record joins over 0.7, so with a cosine over 0.4 to a cluster's text: to its first member's,
    or, from the second on, to a summary sentence.  So texts that are so close over others are a
    part, unless a text of the theme is so close to one of the sentences that its clusters have or
    may come to have; then the theme is one part.  Else clusters of two records or more are left out.
    """
    least = (JOIN_OVER - WEIGHTS[1] - WEIGHTS[2]) / WEIGHTS[0] - 1e-9
    key = lambda tf: F.sha2(F.array_join(F.transform(tf, lambda x: F.concat_ws(":", x.bucket, x.n.cast("long"))), " "), 256)
    rows = rows.withColumn("_text", F.coalesce("text", F.lit("")))
    texts = write_and_read(bucket_vectors(rows.select(F.col("_text").alias("id"), F.col("_text").alias("text")).distinct()).withColumn("rep", key(F.col("tf"))), "texts")
    vectors, most = texts.select("rep", "tf"), rows.count()
    if known is not None:
        themes = rows.where("ts is not null").select("theme").distinct()
        fresh = known.where("volume = 1").join(themes, "theme", "left_semi").withColumn("tf", F.col("vector").cast(texts.schema["tf"].dataType))
        fresh = write_and_read(fresh.withColumn("rep", key(F.col("tf"))), "fresh")
        vectors = vectors.union(fresh.select("rep", "tf"))
        most += known.agg(F.max("volume")).first()[0] or 0
    vectors = write_and_read(vectors.where(F.size("tf") > 0).dropDuplicates(["rep"]), "vectors")
    grouped = write_and_read(components(pairs_over(vectors, least, 256)).select(F.col("id").alias("rep"), F.col("component")), "grouped")
    volumes = F.array(*map(F.lit, summary_volumes(most)))
    themes = rows.where("theme is not null").select("theme").distinct().withColumn("volume", F.explode(volumes))
    sentence = F.concat(F.lit("Cluster of "), F.col("volume").cast("string"), F.lit(" feedback items about "), F.col("theme"))
    sentences = write_and_read(same_vector(themes.select(sentence.alias("id"), sentence.alias("text")).distinct()), "sentences")
    asked = texts.select("rep", "tf").where(F.size("tf") > 0).dropDuplicates(["rep"])
    close = pairs_over(asked, least, 256, others=sentences.where(F.col("id") == F.col("rep")).select("rep", "tf"))
    close = close.select(F.col("a").alias("rep"), F.col("b").alias("_s")).join(sentences.select("id", F.col("rep").alias("_s")), "_s").join(themes.withColumn("id", sentence), "id").select("rep", "theme")
    placed = rows.join(texts.select(F.col("id").alias("_text"), "rep"), "_text")
    whole = write_and_read(placed.join(close.distinct(), ["rep", "theme"], "left_semi").select("theme").distinct().withColumn("_whole", F.lit(True)), "whole-themes")
    lone = F.col("_whole").isNull()
    part = {"part": F.when(lone, F.hex(F.xxhash64(F.coalesce("component", "rep")))).otherwise(""), "lone": lone}

    def parted(x: DataFrame) -> DataFrame:
        return x.join(grouped, "rep", "left").join(whole, "theme", "left").withColumns(part).drop("_text", "rep", "tf", "component", "_whole")

    out = parted(placed)
    if known is None:
        return out, None
    used = write_and_read(out.where("theme is not null and ts is not null").select("theme", "part").distinct(), "parts")
    some = parted(fresh).where("lone").join(used, ["theme", "part"], "left_semi")
    every = known.join(whole.select("theme"), "theme", "left_semi").withColumns({"part": F.lit(""), "lone": F.lit(False)})
    return out, some.unionByName(every)


def online_clusters(rows: DataFrame, idle_days: int | None = None) -> DataFrame:
    """``rows(feedback_id, theme, ts, text, latitude, longitude)`` -> (feedback_id, theme,
    cluster_id).

    A record's score with a cluster of another theme is at most 0.7, which does not join, so
    themes are independent, and so are the parts of a theme that ``apart`` finds.  The records of a
    part stream through its clusters in (time, id) order; a task holds the clusters that may still
    take records, not the records.  The first member's place and, from the second member on, the
    summary sentence stand for a cluster.
    """
    needed = rows.select("feedback_id", "theme", "ts", "text", "latitude", "longitude")
    return fold_clusters(apart(needed), None, idle_days).select("feedback_id", "theme", "cluster_id")


def fold_onto(rows: DataFrame, known: DataFrame, idle_days: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` through the clusters ``known`` of earlier rows: (feedback_id, theme, cluster_id) of
    each, and the clusters that changed or, with ``gone``, were idle for over ``idle_days`` before
    the latest of their theme's rows."""
    rows = rows.select("feedback_id", "theme", "ts", "text", "latitude", "longitude")
    placed, old = apart_from(rows, known)
    folded = write_and_read(fold_clusters(placed, old, idle_days), "folded")
    changed = folded.where("feedback_id is null").drop("feedback_id")
    latest = rows.where("theme is not null and ts is not null").groupBy("theme").agg(F.max(F.unix_micros("ts")).alias("_latest"))
    gone = F.col("_latest") - F.col("seen") > idle_days * 86_400_000_000
    rest = known.join(changed.select("cluster_id"), "cluster_id", "left_anti").join(latest, "theme").where(gone)
    after = changed.join(latest, "theme").unionByName(rest).withColumn("gone", gone).drop("_latest")
    return folded.where("feedback_id is not null").select("feedback_id", "theme", "cluster_id"), after


def geo_cell(lat: Column, lon: Column, reach: int = 0) -> Column:
    """Cells of a place and its neighbours up to ``reach``, 1 for all within 50 km: bands of half a
    degree, cut so that a cell is nowhere under 55 km wide.  Null without a place."""
    band = F.floor(lat * 2)

    def in_band(k: int) -> Column:
        b = band + k
        widest = F.least(F.lit(90.0), F.greatest(F.abs(b), F.abs(b + 1)) / 2)  # the cell is narrowest there
        n = F.greatest(F.lit(1), F.floor(720 * F.cos(F.radians(widest)))).cast("long")
        at = F.floor((lon + 180) / 360 * n).cast("long")
        return F.transform(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]), lambda d: F.struct(b.alias("band"), F.pmod(at + d, n).alias("at")))

    cells = F.array_distinct(F.concat(*[in_band(k) for k in range(-reach, reach + 1)]))
    return F.when(lat.isNotNull() & lon.isNotNull(), cells if reach else cells[0])


def best_cluster_match(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """The best active cluster of a record's own theme over the threshold, from a cluster
    snapshot (cluster_id, theme, summary, latitude, longitude, status).

    A score is over the threshold only with a cosine over 0.4, so different texts meet different
    summaries in ``pairs_over`` first.  Of the clusters of one theme and summary a record's best is
    one within 50 km, which the neighbouring cells hold, or else the last by id: of all for a record
    without a place, else of those with a place, which score alike from there on, and of those without.
    """
    from feedloom.functions.geo import haversine_km

    live = clusters.where("status in ('active', 'monitoring')").select("theme", "cluster_id", F.col("summary").alias("text"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    texts, summaries = (write_and_read(same_vector(x.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(F.col("text").alias("id"), "text")), "texts") for x in (rows, live))
    vectors = [x.where(F.col("id") == F.col("rep")).where(F.size("tf") > 0).select("rep", "tf") for x in (texts, summaries)]
    least = (JOIN_OVER - WEIGHTS[1] - WEIGHTS[2]) / WEIGHTS[0] - 1e-9
    near = pairs_over(vectors[0], least, 256, others=vectors[1])
    # texts without tokens are alike
    bare = [x.where(F.size("tf") == 0).select(F.col("rep").alias(c)).distinct() for c, x in zip("ab", (texts, summaries))]
    pairs = write_and_read(near.union(bare[0].crossJoin(F.broadcast(bare[1])).withColumn("cosine", F.lit(1.0))), "near-texts")  # one row each
    r = rows.join(texts.select(F.col("id").alias("_text"), F.col("rep").alias("a")), F.coalesce("text", F.lit("")) == F.col("_text"))
    r = r.select("feedback_id", "theme", "a", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    c = live.join(summaries.select(F.col("id").alias("_text"), F.col("rep").alias("b")), F.coalesce("text", F.lit("")) == F.col("_text")).select("theme", "b", "cluster_id", "_lat", "_lon")
    placed = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    last = c.groupBy("theme", "b").agg(
        F.max(F.struct("cluster_id", "_lat", "_lon")).alias("all"),
        F.max(F.when(placed, F.struct("cluster_id", "_lat", "_lon"))).alias("with"),
        F.max(F.when(~placed, F.struct("cluster_id", "_lat", "_lon"))).alias("without"),
    )
    asked = write_and_read(r.join(pairs, "a"), "asked")
    here = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ends = F.when(here, F.array("with", "without")).otherwise(F.array("all"))
    by_id = asked.join(last, ["theme", "b"]).select("feedback_id", "cosine", "latitude", "longitude", F.inline(F.filter(ends, lambda x: x.isNotNull())))
    cells = write_and_read(c.where(placed).withColumn("cell", geo_cell(F.col("_lat"), F.col("_lon"))), "cluster-cells")
    around = asked.where(here).withColumn("cell", F.explode(geo_cell(F.col("latitude"), F.col("longitude"), 1)))
    by_cell = around.join(cells, ["theme", "b", "cell"]).select("feedback_id", "cosine", "latitude", "longitude", "cluster_id", "_lat", "_lon")
    both = by_id.union(by_cell)
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    base = WEIGHTS[0] * F.col("cosine") + WEIGHTS[1]
    score = F.when(km.isNull(), base / (WEIGHTS[0] + WEIGHTS[1])).otherwise(base + WEIGHTS[2] * F.greatest(F.lit(0.0), 1 - km / GEO_KM))
    best = F.max(F.struct(score.alias("score"), F.col("cluster_id")))
    return both.where(score > JOIN_OVER).groupBy("feedback_id").agg(best.alias("m")).select("feedback_id", "m.cluster_id", "m.score")
