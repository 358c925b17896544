"""Benchmark decontamination with an FM-index of each training shard.

A shard is one Arrow batch of documents.  Its words are numbered by the benchmark's vocabulary;
words that no benchmark phrase has, and runs too short for any phrase, cannot take part in an
occurrence and become one separator.  Over what is left stand a suffix array sampled at regular
text positions and a wavelet matrix of the Burrows-Wheeler transform.  All phrases are searched
backward at once through wavelet ranks, the occurrences are located by walking to sampled
positions, and overlapping ones are merged to removal spans.

The benchmark's phrases lie in the shared folder in parts of bounded size.  The driver makes one
part at a time, and a task reads one at a time, so neither holds the whole of a large benchmark.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import SPAN, WORDS, joined_spans, new_path, open_shared, release, table, unused, utf8

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Benchmark bytes of a part, about; a part's windows take some ten times as much.
BLOCK_BYTES = 4 << 20
SAMPLE = 8

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling.  The last symbol must be the only smallest one."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over small integers, a bit vector with counts for each bit level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = symbols
        for shift in range(bits - 1, -1, -1):
            one = (now >> shift & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((shift, ones, len(now) - int(ones[-1])))
            now = np.concatenate([now[~one], now[one]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``end``."""
        start = np.zeros_like(end)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = ones[start], ones[end]
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for _, ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of integer symbols 1..top (any may be a separator that no pattern has)."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(top).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns, which are rows of one length."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            lo[live] = self.before[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.wavelet.rank(symbol, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled row are added to its position."""
        out, walked = np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            found = self.kept[rows + 1] > self.kept[rows]
            out[left[found]] = self.sampled[self.kept[rows[found]]] + walked
            left, rows = left[~found], rows[~found]
            symbol = self.wavelet.access(rows)
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            walked += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of benchmark items, by length, over a numbered vocabulary."""

    words: list[bytes] = field(default_factory=list)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], width: int = WINDOW) -> Phrases:
        """A window is ``width`` consecutive words; a shorter item that has words is one window;
        a null or wordless item has none, and one without an id is searched but not named."""
        vocabulary: dict[bytes, int] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        names: dict[str | None, int] = {}
        for item, text in rows:
            words = (text or "").encode().translate(WORDS).split()
            if not words:
                continue
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
            windows = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
            owner = names.setdefault(item, len(names))
            found.setdefault(windows.shape[1], []).append((windows, np.full(len(windows), owner)))
        out = cls(list(vocabulary), items=list(names))
        for n, parts in found.items():
            windows, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * len(names) + np.concatenate([o for _, o in parts]))
            out.windows[n] = windows
            out.owners[n] = np.concatenate([[0], np.cumsum(np.bincount(pairs // len(names), minlength=len(windows)))]), pairs % len(names)
        return out

    def store(self, path: str) -> str:
        with open_shared(path, "w") as f:
            f.write(pickle.dumps(self))
        return path

    def numbers(self) -> dict[bytes, int]:
        if "_numbers" not in self.__dict__:
            self._numbers = {w: k for k, w in enumerate(self.words, 1)}
        return self._numbers

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_numbers"}


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and first[row], first[row] + 1, ... of ranges."""
    row = np.repeat(np.arange(len(first)), size)
    return row, np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def search_shard(texts: Iterable[bytes | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """For each text: its words, the words hit, the items that occur and the merged spans."""
    get, counts, parts = phrases.numbers().get, [], []
    for t in texts:
        words = (t or b"").translate(WORDS).split()
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, itertools.repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))  # no occurrence reaches over the end of a text
    sizes = np.array(counts, np.int64)
    items: list[list[str]] = [[] for _ in counts]
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    hits = np.zeros(len(counts), np.int64)
    if not phrases.windows or not parts:
        return sizes, hits, items, spans
    words = np.concatenate(parts)
    edge = np.flatnonzero(np.diff(np.r_[False, words > 0, False]))
    first, after = edge[::2], edge[1::2]
    long = after - first >= min(phrases.windows)
    first, size = first[long], (after - first)[long]
    if not len(first):
        return sizes, hits, items, spans
    _, place = _expand(first, size + 1)  # each run and the separator behind it
    index = FMIndex(words[place] + 1, len(phrases.words) + 1)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    change, pairs = np.zeros(len(words) + 1, np.int32), []
    for n, windows in phrases.windows.items():
        lo, hi = index.search(windows + 1)
        window, rows = _expand(lo, hi - lo)
        at = place[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        both = np.unique(doc * len(windows) + window)
        offsets, owners = phrases.owners[n]
        doc, window = both // len(windows), both % len(windows)
        row, owner = _expand(offsets[window], offsets[window + 1] - offsets[window])
        pairs.append(doc[row] * len(phrases.items) + owners[owner])
    covered = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        spans[k].append((a - int(starts[k]), b - int(starts[k])))
        hits[k] += b - a
    for pair in np.unique(np.concatenate(pairs)).tolist():
        k, item = divmod(pair, len(phrases.items))
        if phrases.items[item] is not None:
            items[k].append(phrases.items[item])
    return sizes, hits, items, spans


_loaded: dict[str, Phrases] = {}


def _load(path: str) -> Phrases:
    """A part of the benchmark; a worker keeps the last one."""
    if path not in _loaded:
        _loaded.clear()
        with open_shared(path, "r") as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def hits(paths: list[str]):
    """UDF: text -> n_words, n_hit, items, spans, over all parts of the benchmark."""

    @F.arrow_udf(HITS)
    def find(text: pa.Array) -> pa.Array:
        items: list[set[str]] = [set() for _ in range(len(text))]
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(text))]
        for path in paths:
            sizes, _, more, places = search_shard(utf8(text), _load(path))
            for k in range(len(text)):
                items[k].update(more[k])
                spans[k] = joined_spans(spans[k] + places[k]) if places[k] else spans[k]
        rows = [[{"first": a, "after": b} for a, b in x] for x in spans]
        hit = [sum(b - a for a, b in x) for x in spans]
        columns = [pa.array(sizes), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        columns.append(pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))))
        del rows, spans
        release()
        return pa.StructArray.from_arrays(columns, HITS.fieldNames())

    return find


def stored_phrases(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of the phrases of ``benchmark(item_id, text)``, one for each part; at least one."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    folder = new_path(spark, "phrases")
    rows.distinct().withColumn("part", F.pmod(F.xxhash64("item", "t"), F.lit(parts))).repartition("part").write.partitionBy("part").parquet(f"{folder}/items")
    dealt = spark.read.schema("item string, t string, part int").parquet(f"{folder}/items")
    out = []
    for k in range(parts):  # the rows of one part, of bounded size, at a time
        one = dealt.where(F.col("part") == k).select("item", "t").collect()
        out.append(Phrases.of([tuple(r) for r in one], width).store(f"{folder}/{k}.phrases"))
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """Adds a struct ``name`` with n_words, n_hit, items (distinct item_ids as strings, sorted)
    and spans (word ranges to remove, merged) to ``docs(text, ...)``; no row moves.

    A null text has no words; an empty benchmark hits nothing; repeated items count once; an item
    without an id hits and is not named.
    """
    return docs.withColumn(name, hits(stored_phrases(benchmark, width, block_bytes))("text"))


def contaminated(name: str = "hits"):
    hit, words = F.col(f"{name}.n_hit"), F.col(f"{name}.n_words")
    return (hit > 0) & (SHARE * hit >= words)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they are, with all their columns.  Documents
    without words or ids stay; repeated rows are judged each."""
    (name,) = unused(docs, "_hits")
    return with_hits(docs, benchmark, name=name).where(~contaminated(name)).drop(name)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "hits.spans",
    ).drop("spans")


OP1_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), bw as (
  select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') as g
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from (select *, least(13, len(w)) as n from b where len(w) > 0))
), sizes as (
  select distinct n from bw
), dw as (
  select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)
), occ as (
  select dw.doc_id, dw.k, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from occ) group by doc_id
), it as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
  from (select distinct doc_id, cast(item_id as varchar) as i from occ) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""
