"""Ranked lexical search: the best documents for each of a set of queries, exactly.

What a term adds to a document's score is its impact.  A document's impacts fold into a hashed
sketch that holds the maximum of each coordinate, so the sum of a query's coordinates is never
under the document's score.  The queries of a block are looked up in the sketches of many
documents at once; documents are then scored exactly by falling bound until the bound can not
reach the query's k-th best score any more.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom.llm.common import WORDS, materialize, new_path, open_shared, release, table, utf8

TOP = 10
#: Share of a document's length in the weight of its counts, in percent, and the saturation.
LENGTH_SHARE, SATURATION = 90, 8
#: Coordinates of a sketch, documents that are looked up at once, most terms of a block of queries,
#: postings that a task holds at once, and bits that stand for the queries' terms.
COORDINATES, AT_ONCE, BLOCK_TERMS, POSTINGS, TERM_BITS = 4096, 1024, 200_000, 4_000_000, 1 << 22
#: Different words that a counting task holds before it hands them on.
HELD_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


@F.arrow_udf(T.ArrayType(T.StringType()))
def terms(text: pa.Array) -> pa.Array:
    """The different terms of a text, each once."""
    return pa.array([[w.decode() for w in dict.fromkeys(words_of(t))] for t in utf8(text)], pa.list_(pa.string()))


def term_bits(wanted: DataFrame) -> np.ndarray:
    """Which hashes the terms of ``wanted(term)`` have: a fixed number of bits, however many terms.
    A word without its bit is no query's; a word with it is looked up."""
    bit = wanted.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(TERM_BITS - 1).alias("bit"))
    # a row for 64 bits: at most TERM_BITS / 64 rows reach the driver
    rows = bit.groupBy(F.shiftright("bit", 6)).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))).collect()
    out = np.zeros(TERM_BITS // 64, np.int64)
    for at, bits in rows:
        out[at] = bits
    return out


def has_bit(bits: np.ndarray, words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (TERM_BITS - 1)
    return (bits[h >> 6] >> (h & 63)) & 1 == 1


def corpus_counts(docs: DataFrame, bits) -> DataFrame:
    """(term, docs, words): how many texts hold a term of the queries; for term null, how many
    texts have a term and all their terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([*(w.decode() for w in held), None], pa.string()), pa.array([*held.values(), n], pa.int64()), pa.array([0] * len(held) + [total], pa.int64())],
                names=["term", "docs", "words"],
            )

        for batch in batches:
            for text in utf8(batch.column(0)):
                words = words_of(text)
                n, total = n + bool(words), total + len(words)
                different = list(set(words))
                held.update(different[i] for i in np.flatnonzero(has_bit(bits.value, different)))
                if len(held) > HELD_WORDS:
                    yield out()
                    n = total = 0
                    held.clear()
        release()
        yield out()

    return docs.select("text").mapInArrow(count, "term string, docs long, words long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


@dataclass
class Block:
    """Queries of one block: their number and id, their terms as places in ``weight``."""

    place: dict[bytes, int] = field(default_factory=dict)
    weight: list[int] = field(default_factory=list)
    queries: list[tuple[int, object, list[int]]] = field(default_factory=list)
    size: int = 0

    def add(self, number: int, item, found: list[dict]) -> None:
        places = []
        for t in found:
            word = t["term"].encode()
            if word not in self.place:
                self.place[word] = len(self.weight)
                self.weight.append(t["weight"])
            places.append(self.place[word])
        self.queries.append((number, item, places))
        self.size += len(places)


def stored_blocks(queries: DataFrame) -> list[str]:
    """Writes ``queries(_query, item_id, found)`` in blocks of some ``BLOCK_TERMS`` terms to the
    shared folder, in tasks; their paths.  A task that is run again writes files of its own."""
    folder = new_path(queries.sparkSession, "queries")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()

        def stored() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}"
            with open_shared(path, "w") as to:
                to.write(pickle.dumps(block))
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            for row in batch.to_pylist():
                block.add(row["_query"], row["item_id"], row["found"])
                if block.size >= BLOCK_TERMS:
                    yield stored()
                    block = Block()
        if block.queries:
            yield stored()

    return sorted(r.path for r in queries.select("_query", "item_id", "found").mapInArrow(write, "path string").collect())


class Postings:
    """Documents of a task that hold terms of the queries, up to ``POSTINGS`` of these."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.lengths, self.ends = [], [], [0]
        self.terms, self.counts = [], []
        self.size = 0

    def add(self, doc_id, length: int, found: list[tuple[bytes, int]]) -> None:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.terms.append(np.fromiter((self.place.setdefault(w, len(self.place)) for w, _ in found), np.int32, len(found)))
        self.counts.append(np.fromiter((n for _, n in found), np.int32, len(found)))
        self.size += len(found)
        self.ends.append(self.size)


def best_of(postings: Postings, block: Block, n_docs: int, n_words: int, top: int) -> Iterator[tuple]:
    """(query, item_id, doc_id, score) of the ``top`` best of these documents for each query."""
    known = np.full(len(postings.place) + 1, -1, np.int64)
    for word, at in block.place.items():
        known[postings.place.get(word, -1)] = at
    known = known[:-1]  # the last stood for words that no document has
    weight, ends = np.array(block.weight, np.int64), np.array(postings.ends, np.int64)
    mass = 100 - LENGTH_SHARE + LENGTH_SHARE * np.array(postings.lengths, np.int64) * n_docs // max(n_words, 1)
    coordinate = np.fromiter((zlib.crc32(w) % COORDINATES for w in block.place), np.int64, len(block.place))
    queries = [(number, item, np.array(places, np.int64)) for number, item, places in block.queries]
    heaps: list[list[tuple]] = [[] for _ in queries]
    asked = np.zeros(len(weight), bool)
    for first in range(0, len(postings.ids), AT_ONCE):
        after = min(first + AT_ONCE, len(postings.ids))
        ids, bounds_at = postings.ids[first:after], ends[first : after + 1]
        term = known[np.concatenate(postings.terms[first:after])]
        count = np.concatenate(postings.counts[first:after]).astype(np.int64)
        owner = np.repeat(np.arange(after - first), np.diff(bounds_at))
        some = term >= 0
        term, count, owner = term[some], count[some], owner[some]
        impact = weight[term] * (1_000_000_000 * count // (1000 * count + SATURATION * mass[first:after][owner]))
        start = np.searchsorted(owner, np.arange(after - first + 1))
        sketch = np.zeros((COORDINATES, after - first), np.int64)
        np.maximum.at(sketch.reshape(-1), coordinate[term] * (after - first) + owner, impact)
        order = np.empty(after - first, np.int64)  # by falling id, null first: what a tie prefers is last
        order[sorted(range(after - first), key=lambda i: _late(ids[i]))] = np.arange(after - first)
        for (_, _, places), heap in zip(queries, heaps):
            bound = np.zeros(after - first, np.int64)
            for k in range(0, len(places), 512):
                bound += sketch[coordinate[places[k : k + 512]]].sum(axis=0)
            least = heap[0][0] if len(heap) == top else 1
            candidates = np.flatnonzero(bound >= max(least, 1))
            asked[places] = True
            for i in candidates[np.lexsort((-order[candidates], -bound[candidates]))]:
                key = _late(ids[i])
                if len(heap) == top and (bound[i], key) <= heap[0][:2]:
                    break
                own = slice(start[i], start[i + 1])
                score = int(impact[own][asked[term[own]]].sum())
                if score <= 0:
                    continue
                entry = (score, key, first + int(i))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
            asked[places] = False
    for (number, item, _), heap in zip(queries, heaps):
        for score, _, at in heap:
            yield number, item, postings.ids[at], score


class _late:
    """Orders ids the other way round, null lowest: a greater one wins a tie."""

    __slots__ = ("id",)

    def __init__(self, doc_id):
        self.id = doc_id

    def __eq__(self, other):
        return self.id == other.id

    def __lt__(self, other):
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __le__(self, other):
        return self == other or self < other

    def __gt__(self, other):
        return other < self


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of ``docs(doc_id, text)`` for each row of ``queries(item_id, text)``:
    (item_id, rank, doc_id, score), scores above 0 only, equal scores by rising doc_id, null last.

    Null and empty texts match nothing; a query's term counts once.  Rows that repeat a document
    are ranked each; rows that repeat an item are ranked each, and so give its ranks again.
    Empty tables give an empty one.  Queries lie in the shared folder in blocks of a bounded number
    of terms; a task reads its documents' texts once for all blocks and holds one block and at most
    ``POSTINGS`` postings and one text; it hands on ``top`` rows a query for each such load.
    """
    spark = docs.sparkSession
    numbered = materialize(queries.select("item_id", "text").withColumn("_query", F.monotonically_increasing_id()), "items")
    asked = materialize(numbered.select("_query", F.explode(terms("text")).alias("term")), "terms")
    bits = spark.sparkContext.broadcast(term_bits(asked))
    counts = materialize(corpus_counts(docs, bits), "counts")
    n_docs, n_words = counts.where("term is null").select("docs", "words").first() or (0, 0)
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("docs") + 1)))
    weighed = asked.join(counts, "term").select("_query", F.struct("term", weight.alias("weight")).alias("t"))
    found = weighed.groupBy("_query").agg(F.sort_array(F.collect_list("t")).alias("found"))  # one query's terms
    paths = stored_blocks(found.join(numbered.select("_query", "item_id"), "_query"))
    doc_type, item_type = docs.schema["doc_id"].dataType, queries.schema["item_id"].dataType
    names = ["_query", "item_id", "doc_id", "score"]
    kinds = [pa.int64(), to_arrow_type(item_type), to_arrow_type(doc_type), pa.int64()]

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(postings: Postings) -> Iterator[pa.RecordBatch]:
            for path in paths if postings.ids else ():
                with open_shared(path, "r") as source:
                    block = pickle.loads(source.readall())
                rows = list(best_of(postings, block, n_docs, n_words, top))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        postings = Postings()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(text)
                counted = list(Counter(words).items())
                kept = np.flatnonzero(has_bit(bits.value, [w for w, _ in counted]))
                if len(kept):
                    postings.add(doc_id, len(words), [counted[i] for i in kept])
                if postings.size >= POSTINGS:
                    yield from out(postings)
                    postings = Postings()
        yield from out(postings)
        release()

    kind = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), item_type, doc_type, T.LongType()))])
    partial = materialize(docs.select("doc_id", "text").mapInArrow(rank, kind), "partial")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return partial.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents where text is not null
), sizes as (
  select doc_id, len(w)::bigint as n from d where len(w) > 0
), total as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_words from sizes
), tf as (
  select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from d) group by all
), df as (
  select term, count(*)::bigint as df from tf group by term
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null
), scored as (
  select item_id, doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint
             * (1000000000 * tf // (1000 * tf + {SATURATION} * ({100 - LENGTH_SHARE} + {LENGTH_SHARE} * n * n_docs // n_words))))::bigint as score
  from q join df using (term) join tf using (term) join sizes using (doc_id), total
  group by item_id, doc_id
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {TOP}
"""
