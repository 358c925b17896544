"""Substring dedup: paragraphs and passages that documents share.

Paragraphs (lines of more than ``LONG`` words, and runs of shorter lines that have more together;
a run ends at an empty or a longer line) get MinHash signatures over five-word shingles;
paragraphs that agree on a band are joined to the first of the band, verified by the exact
Jaccard similarity of their shingle sets, and the components of the verified links keep the
paragraphs of their first document.  A passage may also stand inside longer text, so rolling
paragraphs are compared as well: blocks of 32 words that begin at the smallest shingle hash of any
20 neighbouring shingles (a one-row band over each rolling window).  Each passage of 51 words has
such a block inside it wherever it stands.  A word is cut if a window of 51 words around it stands
in one earlier document.  Blocks meet by a 64-bit hash with their places, and a run of touching
blocks that stand alike in *one* earlier document is a repeated passage if it has over ``LONG``
words; around its first and its last block, and around blocks of no such run, the words decide, by
a byte of each: each window that holds the block is looked for in the other documents, too.  All
documents that have a window are linked to the first of them.

Documents are compared with each other: what one document repeats inside itself stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import LOWER, SPAN, collected, joined_spans, materialize, merged, release, slices, table, unused, utf8
from feedloom.llm.components import connected_components

SHINGLE, LONG = 5, 50
SIMILAR, RECALL, HASHES = 0.8, 0.99, 24
#: Paragraphs of a block, if they are of ``USUAL`` shingles; two blocks are compared at once.
COMPARED, USUAL = 128, 200
#: Words of a task's working set.
CHUNK = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.uint64(0xD1B54A32D192ED03)
_OTHER = np.uint64(0xA24BAED4963EE407)


def tune_bands(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands that find pairs of the similarity with the recall in so
    many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similar**rows))) if similar**rows < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"no bands of {hashes} hashes reach recall {recall} at similarity {similar}")
    return best


def block_shape(long: int) -> tuple[int, int]:
    """Words of a block and neighbouring shingles of which one begins a block, so that every
    ``long + 1`` words hold a whole block: 32 and 20 at 50."""
    window = (long + 2) * 2 // 5
    block = long + 2 - window
    if block < SHINGLE:
        raise ValueError(f"passages of {long + 1} words are too short for blocks of {SHINGLE} words")
    return block, window


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ROOT
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: np.uint64 = _ROOT) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for k in range(n - 2, -1, -1):
        out[k] = out[k + 1] * base
    return out


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = pick(x[: len(x) - width], x[width:])
        width *= 2
    rest = n - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(shingle: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of any ``window`` neighbours; of equal neighbours in a row
    every 16th, or nearer in a smaller window."""
    n = len(shingle)
    if n < window:
        return np.zeros(0, np.int64)
    least = _sliding(shingle, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    at = np.flatnonzero(most == shingle)
    run = np.r_[True, (at[1:] != at[:-1] + 1) | (shingle[at[1:]] != shingle[at[:-1]])]
    start = at[run][np.cumsum(run) - 1]
    last = np.r_[run[1:], True]
    return at[((at - start) % min(16, window) == 0) | last]


class Chunk:
    """Words of several documents in one array, with the bounds of documents and paragraphs."""

    def __init__(self, long: int = LONG, paragraph: int = LONG) -> None:
        self.long = max(paragraph, SHINGLE - 1)
        self.block, self.window = block_shape(long)
        self.words: list[int] = []
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.lines: list[tuple[int, int, int, int]] = []  # document, first line, first word, after

    def add(self, doc_id: int, text: bytes | None) -> None:
        digest, k = xxhash.xxh64_intdigest, len(self.ids)
        run = 0, len(self.words)  # line and first word
        for line, part in enumerate((text or b"").translate(LOWER).split(b"\n")):
            words = part.split()
            alone = len(words) > self.long
            if alone or not words:
                self.paragraph(k, *run)
                run = line, len(self.words)
            self.words.extend(map(digest, words))
            if alone:
                self.paragraph(k, *run)
                run = line + 1, len(self.words)
        self.paragraph(k, *run)
        self.ids.append(doc_id)
        self.ends.append(len(self.words))

    def paragraph(self, k: int, line: int, first: int) -> None:
        if len(self.words) - first > self.long:
            self.lines.append((k, line, first, len(self.words)))

    def rows(self, bands: int, rows: int) -> pa.RecordBatch:
        word = np.array(self.words, np.uint64)
        ends = np.array(self.ends)
        starts = np.r_[0, ends[:-1]]
        count = len(word)
        doc_of = np.repeat(np.arange(len(ends)), ends - starts)
        lists: dict[str, pa.Array] = {}
        with np.errstate(over="ignore"):
            n = max(0, count - SHINGLE + 1)
            shingle = np.zeros(n, np.uint64)
            for k, p in enumerate(_powers(SHINGLE)):
                shingle += word[k : k + n] * p
            shingle = _mix(shingle)
            within = doc_of[:n] == doc_of[SHINGLE - 1 :] if n else np.zeros(0, bool)
            at = anchors(np.where(within, shingle, np.uint64(2**64 - 1)), self.window)
            at = at[at + self.block <= ends[doc_of[at]]]
            key = np.zeros(len(at), np.uint64)
            for k, p in enumerate(_powers(self.block)):
                key += word[at + k] * p
            key = _mix(key)
            lists["blocks"] = _list(np.bincount(doc_of[at], minlength=len(ends)), {"pos": at - starts[doc_of[at]], "key": key.view(np.int64)})
            line = np.array(self.lines, np.int64).reshape(-1, 4)
            per = np.bincount(line[:, 0], minlength=len(ends))
            size = line[:, 3] - line[:, 2] - SHINGLE + 1
            edge = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(line[:, 2] - edge[:-1], size) + np.arange(edge[-1])
            chosen = shingle[place]
            least = np.zeros((len(line), bands * rows), np.uint64)
            for k in range(bands * rows if len(line) else 0):
                seed = _mix(np.array([k + 1], np.uint64) * _ODD)
                least[:, k] = np.minimum.reduceat((chosen ^ seed) * (seed * _ROOT | np.uint64(1)), edge[:-1])
            band = np.zeros((len(line), bands), np.uint64)
            for k in range(bands):
                band[:, k] = k
                for r in range(rows):
                    band[:, k] = _mix(band[:, k] * _ROOT + least[:, k * rows + r])
            whole, check = np.zeros((2, len(line)), np.uint64)
            if len(line):
                place_in = _mix((np.arange(edge[-1]) - np.repeat(edge[:-1], size)).astype(np.uint64))
                whole, check = (_mix(np.add.reduceat(_mix(chosen + place_in ^ base), edge[:-1]) + size.astype(np.uint64)) for base in (_ROOT, _OTHER))
        first, after = line[:, 2] - starts[line[:, 0]], line[:, 3] - starts[line[:, 0]]
        lists["paragraphs"] = _list(per, {"line": line[:, 1].astype(np.int32), "first": first, "after": after, "whole": whole.view(np.int64), "check": check.view(np.int64), "bands": _nested(np.full(len(line), bands), band.view(np.int64).ravel())})
        # four bytes a shingle: sets of all paragraphs are the largest table here
        own = np.unique(np.repeat(np.arange(len(line), dtype=np.uint64), size) << np.uint64(32) | (chosen >> np.uint64(32)))
        sizes = np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=len(line))
        lists["sets"] = _list(per, {"line": line[:, 1].astype(np.int32), "shingles": _nested(sizes, own.astype(np.uint32).view(np.int32))})
        # one byte a word, to compare the words around a block
        short = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer((word >> np.uint64(56)).astype(np.uint8).tobytes())])
        arrays = [pa.array(self.ids, pa.int64()), pa.array(ends - starts), short, lists["blocks"], lists["paragraphs"], lists["sets"]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "words", "blocks", "paragraphs", "sets"])


def _nested(sizes: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values) if isinstance(values, np.ndarray) else values)


def _list(sizes: np.ndarray, columns: dict) -> pa.ListArray:
    fields = [pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()]
    return _nested(sizes, pa.StructArray.from_arrays(fields, list(columns)))


PROFILE = (
    "doc_id long, n_words long, words binary, blocks array<struct<pos:long,key:long>>,"
    "paragraphs array<struct<line:int,first:long,after:long,whole:long,check:long,bands:array<long>>>,"
    "sets array<struct<line:int,shingles:array<int>>>"
)


def _profiler(bands: int, rows: int, long: int = LONG, paragraph: int = LONG):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(long, paragraph)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                chunk.add(doc_id, text)
                if len(chunk.words) > CHUNK:
                    yield chunk.rows(bands, rows)
                    chunk = Chunk(long, paragraph)
        if chunk.ids:
            yield chunk.rows(bands, rows)
        del chunk
        release()

    return profile


RUNS = "struct<sure:array<struct<first:long,after:long,other:long>>,doubtful:array<struct<key:long>>,open:array<struct<places:array<long>,key:long,low:int,high:int>>>"


def _runs(long: int):
    """UDF: a document's shared blocks, with the first document that has each and the place there
    -> spans of sure runs, which have over ``long`` words, the blocks that the words decide, and
    the blocks of which the words are looked at if any document doubts them.

    A run's blocks touch and stand as far apart in one other document, so all its words do.
    Windows inside a sure run are that document's as well, so they are left out: those that begin
    from ``low`` to ``high`` words behind the block, which is all of a block deep in the run.
    Equal blocks of which the same windows are looked at, as where a word is repeated, are one with
    their places.
    """
    block, _ = block_shape(long)
    reach = long + 1 - block

    @F.arrow_udf(RUNS)
    def runs(blocks: pa.Array) -> pa.Array:
        out = []
        for row in blocks.to_pylist():
            row = sorted((x["other"], x["pos"] - x["place"], x["pos"], x["key"]) for x in row)
            groups: list[list[tuple]] = []
            for x in row:
                if not groups or groups[-1][-1][:2] != x[:2] or groups[-1][-1][2] + block < x[2]:
                    groups.append([])
                groups[-1].append(x)
            sure, doubtful, open_ = [], set(), {}
            for g in groups:
                first, after = g[0][2], g[-1][2] + block
                if after - first > long:
                    sure.append({"first": first, "after": after, "other": g[0][0]})
                    doubtful |= {g[0][3], g[-1][3]}  # the passage may begin before and end behind them
                    for _, _, pos, key in g:
                        low, high = first - pos, after - long - 1 - pos
                        if low > -reach or high < 0:
                            open_.setdefault((key, max(low, -reach), min(high, 0)), []).append(pos)
                else:
                    doubtful |= {x[3] for x in g}
                    for x in g:
                        open_.setdefault((x[3], 1, 0), []).append(x[2])
            asked = [{"places": sorted(places), "key": key, "low": low, "high": high} for (key, low, high), places in open_.items()]
            out.append({"sure": sure, "doubtful": [{"key": k} for k in sorted(doubtful)], "open": asked})
        spans, keys = (pa.list_(pa.struct([(c, pa.int64()) for c in names])) for names in (("first", "after", "other"), ("key",)))
        blocks = pa.list_(pa.struct([("places", pa.list_(pa.int64())), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))
        return pa.array(out, pa.struct([("sure", spans), ("doubtful", keys), ("open", blocks)]))

    return runs


NEAR = "array<struct<places:array<long>,key:long,low:int,high:int,lead:int,near:binary>>"


def _contexts(long: int):
    """UDF: a document's words (one byte each) and shared blocks -> each block with the words
    that a window of long + 1 words around it may have, and how many of them lead it.  Blocks of
    a document that are alike in all this, as where a word is repeated, are one with its places."""
    block, _ = block_shape(long)
    reach = long + 1 - block
    names = ["places", "key", "low", "high", "lead", "near"]
    kind = pa.list_(pa.struct(list(zip(names, (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())))))

    @F.arrow_udf(NEAR)
    def contexts(words: pa.Array, blocks: pa.Array) -> pa.Array:
        out = []
        for w, row in zip(words, blocks.to_pylist()):
            word, one = w.as_py(), {}
            for x in row:
                for pos in x["places"]:
                    lo = max(0, pos - reach)
                    context = x["key"], x["low"], x["high"], pos - lo, word[lo : pos + block + reach]
                    one.setdefault(context, []).append(pos)
            out.append([dict(zip(names, (sorted(places), *context))) for context, places in one.items()])
        return pa.array(out, kind)

    return contexts


def _windows(long: int):
    """UDF: a block's hash and the words around it -> (start, window): where windows of long + 1
    words that hold the block begin, from the block on, and a hash of block and words.  Those that
    begin from ``low`` to ``high`` are left out."""
    width = long + 1

    @F.arrow_udf("array<struct<start:int,window:long>>")
    def windows(key: pa.Array, low: pa.Array, high: pa.Array, lead: pa.Array, near: pa.Array) -> pa.Array:
        out = []
        with np.errstate(over="ignore"):
            for block, least, most, first, w in zip(key.to_numpy().view(np.uint64), low.to_pylist(), high.to_pylist(), lead.to_pylist(), near):
                word = np.frombuffer(w.as_py(), np.uint8).astype(np.uint64) + np.uint64(1)
                hashes = []
                if len(word) >= width:
                    each = np.lib.stride_tricks.sliding_window_view(_mix(word), width)
                    hashes = _mix((each * _powers(width, _OTHER)).sum(axis=1, dtype=np.uint64) ^ block).view(np.int64).tolist()
                out.append([{"start": k - first, "window": h} for k, h in enumerate(hashes) if not least <= k - first <= most])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("window", pa.int64())])))

    return windows


def _passages(profiles: DataFrame, long: int) -> DataFrame:
    """(doc_id, first, after, other): passages of over ``long`` words that a document with a
    smaller id has too.  All documents with a window of a passage are linked over ``other``."""
    blocks = profiles.select("doc_id", F.inline("blocks"))
    shared = blocks.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("o"), F.max("doc_id").alias("_last")).where("o.doc_id < _last")
    shared = shared.select("key", F.col("o.doc_id").alias("other"), F.col("o.pos").alias("place"))
    shared = materialize(shared, "shared-blocks")  # the join then reads plain shuffles, which split where a key is frequent
    # a document with the smallest id is no repeat, but its words may be asked for
    met = materialize(blocks.join(shared, "key").select("doc_id", "pos", "key", "other", "place"), "met-blocks")
    later = met.where("doc_id > other")
    told = later.groupBy("doc_id").agg(_runs(long)(F.collect_list(F.struct("pos", "key", "other", "place"))).alias("r"))
    told = materialize(told.select("doc_id", "r.*"), "runs")
    sure = told.select("doc_id", F.inline("sure"))
    doubtful = materialize(told.select(F.inline("doubtful")).distinct(), "doubtful-blocks")
    least = met.where("doc_id = other").groupBy("doc_id", "key").agg(F.collect_list("pos").alias("places"))
    least = least.select("doc_id", "places", "key", F.lit(1).alias("low"), F.lit(0).alias("high"))
    # a row a document and block, however often the document has it
    asked = told.select("doc_id", F.inline("open")).union(least).join(doubtful, "key", "left_semi")
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("places", "key", "low", "high")).alias("blocks"))
    near = profiles.select("doc_id", "words").join(asked, "doc_id").select("doc_id", F.inline(_contexts(long)("words", "blocks")))
    # from here on a context goes by its hash; copies of a passage share it, and it is looked at once
    words = ["key", "low", "high", "lead", "near"]
    near = materialize(near.withColumn("context", F.xxhash64(*words)), "contexts")
    once = near.groupBy("context").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), *(F.first(c).alias(c) for c in words))
    held = materialize(once.select("context", "first_doc", "last_doc", F.inline(_windows(long)(*words))), "windows")
    both = held.groupBy("window").agg(F.min("first_doc").alias("other"), F.max("last_doc").alias("_last")).where("other < _last").drop("_last")
    both = materialize(both, "shared-windows")
    places = held.select("context", "start", "window").join(both, "window").groupBy("context").agg(F.collect_list(F.struct("start", "other")).alias("at"))
    places = materialize(places, "shared-contexts")
    earlier = F.filter("at", lambda x: x.other < F.col("doc_id"))
    # a row a document and context, however often the document has it
    more = near.select("doc_id", "places", "context").join(places, "context").withColumn("at", earlier).where(F.size("at") > 0)
    starts = F.transform("at", lambda x: x.start)
    # all windows hold the block, so together they are one span, and places whose spans touch are one,
    # too; each of their documents is a link, and as spans and links are each taken by themselves
    # later, each stands here once
    others = F.array_distinct(F.transform("at", lambda x: x.other))
    more = more.withColumns({"others": others, "low": F.array_min(starts), "high": F.array_max(starts) + long + 1})
    apart = lambda p, q: F.coalesce(q - p > F.col("high") - F.col("low"), F.lit(True))  # noqa: E731  no place: the first or the last
    begin = F.filter("places", lambda p, i: apart(F.get("places", i - 1), p))
    end = F.filter("places", lambda p, i: apart(p, F.get("places", i + 1)))
    spans = F.zip_with(begin, end, lambda p, q: F.struct((p + F.col("low")).alias("first"), (q + F.col("high")).alias("after")))
    more = more.select("doc_id", "others", spans.alias("spans"))
    links = F.transform("others", lambda x: F.struct(F.col("spans")[0].first.alias("first"), F.col("spans")[0].after.alias("after"), x.alias("other")))
    rest = F.transform(F.slice("spans", 2, F.size("spans")), lambda x: F.struct(x.first.alias("first"), x.after.alias("after"), F.col("others")[0].alias("other")))
    return sure.union(more.select("doc_id", F.inline(F.concat(links, rest))))


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is at least SIMILAR."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= SIMILAR * (len(x) + len(y) - common)


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are pairs of blocks of paragraphs; emits links that span their similar pairs.

    Paragraphs with ``hit`` are linked already, all by the first of their band.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            out = _block_links(batch.column("xs")[k], batch.column("ys")[k], batch.column("hit")[k].as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32()) * 2)], ["d1", "l1", "d2", "l2"])
        release()


def _members(block: pa.ListScalar) -> list[tuple[int, tuple[int, int], np.ndarray]]:
    """(size, paragraph, shingles) in order of size."""
    rows = block.values
    sets = rows.field("shingles")
    sets = [x.values.to_numpy() for x in sets]
    return sorted(zip(map(len, sets), zip(rows.field("doc_id").to_pylist(), rows.field("line").to_pylist()), sets), key=lambda p: p[:2])


def _block_links(xs: pa.ListScalar, ys: pa.ListScalar, hit: bool) -> list[tuple]:
    one, two = _members(xs), _members(ys)
    hits = [p for _, p, _ in two] if hit else []
    parent: dict[tuple, tuple] = dict.fromkeys(hits, min(hits, default=None))

    def find(x: tuple) -> tuple:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    low, out = 0, []
    for n, p, x in one:
        while low < len(two) and two[low][0] < SIMILAR * n:
            low += 1
        for m, q, y in two[low:]:
            if m * SIMILAR > n:
                break
            a, b = find(p), find(q)
            if a != b and _alike(x, y):
                parent[max(a, b)] = min(a, b)
                out.append((*p, *q))
    return out


def _similar_paragraphs(profiles: DataFrame) -> DataFrame:
    """Links (a, b) of paragraphs (doc_id, line) whose shingle sets have Jaccard >= SIMILAR.

    Equal paragraphs are linked to the first of them, which alone goes to the bands.  In a band
    all are compared with the first; those that it does not match are compared with each other and
    with those that it matches, in pairs of blocks of bounded size, so that every pair that met in
    a band is decided, or linked over the first.
    """
    paragraphs = profiles.select("doc_id", F.inline("paragraphs"))
    who = F.struct("doc_id", "line")
    groups = paragraphs.groupBy("whole", "check").agg(F.min(F.struct("doc_id", "line", "bands")).alias("_first"), F.count("*").alias("_n"))
    groups = materialize(groups.select("whole", "check", F.struct("_first.doc_id", "_first.line").alias("b"), F.col("_first.bands").alias("bands"), "_n"), "paragraphs")
    equal = paragraphs.select(who.alias("a"), "whole", "check").join(groups.where("_n > 1").select("whole", "check", "b"), ["whole", "check"]).where("a <> b").select("a", "b")
    sets = profiles.select("doc_id", F.inline("sets")).select(who.alias("p"), "shingles")
    banded = groups.select(F.col("b").alias("a"), F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("_last")).where("b <> _last").drop("_last")
    met = materialize(banded.join(first, "band").where("a <> b"), "met")
    pairs = met.select("a", "b").distinct()
    needed = pairs.select(F.col("a").alias("p")).union(pairs.select(F.col("b").alias("p"))).distinct()
    few = materialize(sets.join(needed, "p", "left_semi"), "shingle-sets")
    both = pairs.join(few.select(F.col("p").alias("a"), F.col("shingles").alias("x")), "a").join(
        few.select(F.col("p").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    verified = both.where(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b")
    verified = materialize(verified, "verified")
    members = met.join(verified.withColumn("_hit", F.lit(True)), ["a", "b"], "left").select("a", "band", F.coalesce("_hit", F.lit(False)).alias("hit"))
    members = members.join(few.select(F.col("p").alias("a"), F.size("shingles").alias("n")), "a")
    sums = [F.sum(F.when(F.col("hit") == h, F.col("n") + 1)).alias(c) for c, h in (("_hits", True), ("_rest", False))]
    counts = members.groupBy("band").agg(*sums, F.count("*").alias("_n")).where("_rest > 0 and _n > 1").drop("_n")
    size = F.when(F.col("hit"), F.col("_hits")).otherwise(F.col("_rest"))
    dealt = members.join(counts, "band").withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(size / (COMPARED * USUAL))))
    entry = F.struct("a.doc_id", "a.line", "shingles")
    blocks = dealt.join(few.withColumnRenamed("p", "a"), "a").groupBy("band", "hit", "part").agg(F.collect_list(entry).alias("xs"))
    blocks = materialize(blocks, "band-blocks")
    against = blocks.select("band", "hit", F.col("part").alias("_part"), F.col("xs").alias("ys"))
    both = blocks.where("not hit").drop("hit").join(against, "band").where("hit or part <= _part")
    compared = both.select("xs", "ys", "hit").mapInArrow(_compare_blocks, "d1 long, l1 int, d2 long, l2 int")
    later = compared.select(*(F.struct(F.col(f"d{k}").alias("doc_id"), F.col(f"l{k}").alias("line")).alias(c) for k, c in ((1, "a"), (2, "b"))))
    return equal.union(verified).union(later)


def _keyed(docs: DataFrame, mark: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents with the number ``mark`` that each is compared by, and (doc_id, hash, mark) if
    that is not the id.

    Rows with one id and other texts are documents of their own.  Only where there are such, ids
    and text hashes are numbered in their order, and the texts are joined to the numbers.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("substring dedup compares documents by integer ids")
    own = docs.withColumn(mark, F.col("doc_id").cast("long"))
    hashed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_hash"))
    versions = hashed.groupBy("doc_id").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b"), F.count("*").alias("n"))
    if versions.where("n > 1 and a <> b").isEmpty():
        return own, None
    ordered = hashed.distinct().orderBy("doc_id", "_hash").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ordered = materialize(ordered, "versions")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a row a part
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    numbers = ordered.join(F.broadcast(first), "_part").select("doc_id", "_hash", (F.col("_first") + at).alias(mark))
    numbers = materialize(numbers, "numbers")
    on = (docs.doc_id == numbers.doc_id) & (F.xxhash64(docs.text) == numbers["_hash"])
    return docs.join(numbers, on, "left").select(*[docs[c] for c in docs.columns], mark), numbers


def _repeats(docs: DataFrame, mark: str, long: int, paragraph: int) -> DataFrame:
    """``docs(mark, text)`` -> (doc_id, n_words, n_removed, spans, component), by the number."""
    block_shape(long)
    bands, rows = tune_bands()
    known = docs.where(F.col(mark).isNotNull()).select(F.col(mark).alias("doc_id"), "text")
    profiles = materialize(known.mapInArrow(_profiler(bands, rows, long, paragraph), PROFILE), "profiles")
    passages = materialize(_passages(profiles, long), "passages")
    links = materialize(_similar_paragraphs(profiles), "links")
    classes = connected_components(links).where("id.doc_id <> component.doc_id")
    places = profiles.select("doc_id", F.inline("paragraphs")).select(F.struct("doc_id", "line").alias("id"), "first", "after")
    lines = places.join(classes, "id").select("id.doc_id", "first", "after", F.col("component.doc_id").alias("other"))
    found = materialize(passages.union(lines), "repeats")
    spans = found.groupBy("doc_id").agg(merged(F.collect_set(F.struct("first", "after"))).alias("spans"))
    spans = materialize(spans, "spans")  # a task that cuts texts, too, would take a second Python worker
    of_doc = connected_components(found.select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    whole = profiles.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.after - x.first)
    out = whole.join(spans, "doc_id", "left").join(of_doc.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def repeats(docs: DataFrame, long: int = LONG, paragraph: int = LONG) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row per document: doc_id, n_words, n_removed, spans (word
    ranges to remove, merged) and component_id (the smallest doc_id that is reachable over shared
    passages, its own included).

    The document with the smallest id keeps a passage; shared passages of ``long`` or fewer words
    and paragraphs of ``paragraph`` or fewer (down to one shingle of five) are left alone.  A cut
    passage is cut whole.  Words are split at white space and compared with A-Z in lower
    case.  Ids are integers, else a TypeError.  Documents without an id have no row and are not
    compared.  Rows with one id and one text are one document, with one row; rows with one id and
    other texts are documents of their own, each with a row, in the order of their text hashes.
    Null and empty texts have no words and nothing to remove.
    """
    keyed, numbers = _keyed(docs.select("doc_id", "text"), "_key")
    out = _repeats(keyed, "_key", long, paragraph)
    if numbers is None:
        return out
    ids = numbers.select(F.col("_key"), F.col("doc_id").cast("long").alias("_own"))
    known = out.join(ids, out.doc_id == ids._key).drop("doc_id", "_key")
    roots = ids.select(F.col("_key").alias("component_id"), F.col("_own").alias("_root"))
    return known.join(roots, "component_id").select(F.col("_own").alias("doc_id"), "n_words", "n_removed", "spans", F.col("_root").alias("component_id"))


def _without(t: bytes | None, row: list[dict] | None) -> bytes | None:
    if t is None or not row:
        return t
    data = np.frombuffer(t, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.append(np.flatnonzero(~blank & np.r_[True, blank[:-1]]), len(t))
    kept, at = [], 0
    for x in row:
        first, after = (int(starts[min(x[k], len(starts) - 1)]) for k in ("first", "after"))
        kept.append(t[at:first])
        at = after
    return b"".join([*kept, t[at:]])


@F.arrow_udf(T.StringType())
def cut_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text without the word ranges; what remains is unchanged."""
    if isinstance(text, pa.ChunkedArray):
        text, spans = text.combine_chunks(), spans.combine_chunks()

    def parts() -> Iterator[pa.Array]:
        at = 0
        for part in slices(text, 64):
            rows = spans.slice(at, len(part)).to_pylist()
            at += len(part)
            yield pa.array(list(map(_without, utf8(part), rows)), pa.binary()).cast(pa.string()) if any(rows) else part.cast(pa.string())

    return collected(parts(), pa.string())


def without_repeats(docs: DataFrame, long: int = LONG, paragraph: int = LONG) -> DataFrame:
    """The documents with repeated passages cut, as ``repeats`` tells; those of which no word is
    left go.  Documents without repeats, ids or texts stay as they are, and so do all columns;
    rows with one id and one text are cut alike."""
    mark, spans, key, gone = unused(docs, "_key", "_spans", "_other", "_gone")
    keyed, numbers = _keyed(docs, mark)
    found = _repeats(keyed.select(mark, "text"), mark, long, paragraph).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias(key), F.col("spans").alias(spans), (F.col("n_removed") == F.col("n_words")).alias(gone))
    # told by the counts: a filter on the cut text would cut all texts twice, in two Python workers a task
    left = keyed.join(found, F.col(mark) == F.col(key), "left").where(F.col(gone).isNull() | ~F.col(gone))
    return left.withColumn("text", cut_spans("text", spans)).select(*docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
