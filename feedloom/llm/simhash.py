"""SimHash near-duplicates: fingerprints linked by a self-join of binary tries.

Two fingerprints within three bits agree on at least one of four 16-bit blocks.  Each distinct
fingerprint therefore goes to four shards, one for each block value; a shard is a binary trie
whose first levels are that block.  Inside a shard pairs of trie nodes are walked together: the
bits that differ above both nodes' branches are counted, and a pair beyond the budget is pruned.
A block value that holds too many fingerprints is dealt out again by the blocks of its remaining
bits, so that a shard has a fixed bound of ``MAX_SHARD`` values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import LOWER, materialize, table, unused, utf8
from feedloom.llm.components import connected_components

SEED = 42
SHINGLE = 3
BUDGET = 3
#: Values of one shard; at 44 fixed bits only 2^20 values are left, so the dealing ends there.
MAX_SHARD = 1 << 20
#: Node pairs that are expanded at once.
CHUNK = 1 << 16


def simhash(text: bytes | None) -> int:
    """64-bit fingerprint: bit set where over half of the shingle hashes have it.

    Null, empty and blank texts have no shingle and the fingerprint 0; a text of fewer words
    than a shingle is one shingle.  Repeated shingles count each time.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :].tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        counts += bits[at : at + (1 << 16)].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    values = np.array([simhash(x) for x in utf8(text)], np.uint64)
    return pa.array(values.view(np.int64))


def _masks(budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """Masks by level as (mask, mask it refines): each has one of budget + 1 blocks of the
    bits that the coarser mask leaves free."""
    levels, now = [], [(0, -1)]
    while not levels or bin(levels[-1][0][0]).count("1") < 44:
        after = []
        for parent, (mask, _) in enumerate(now):
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [round(i * len(free) / (budget + 1)) for i in range(budget + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                after.append((mask | sum(1 << b for b in free[lo:hi]), parent))
        levels.append(after)
        now = after
    return levels


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_length(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


class Trie:
    """Binary tries, one for each run of equal ``group``, over sorted distinct ``values``;
    chains of single children are compressed.  ``bit`` is a node's branching bit, -1 at leaves."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
        lo, hi = first, np.r_[first[1:], len(group)][: len(first)]
        self.roots = len(lo)
        parts: dict[str, list] = {"lo": [], "hi": [], "bit": [], "left": []}
        made = 0
        while len(lo):
            bit = _bit_length(values[lo] ^ values[hi - 1]).astype(np.int64) - 1
            bit[hi - lo == 1] = -1
            inner = bit >= 0
            made += len(lo)
            left = np.full(len(lo), -1)
            left[inner] = made + 2 * np.arange(inner.sum())
            for k, v in (("lo", lo), ("hi", hi), ("bit", bit), ("left", left)):
                parts[k].append(v)
            a, b, shift = lo[inner], hi[inner], bit[inner].astype(np.uint64)
            low, high = a.copy(), b.copy()  # first value of the node that has the branching bit
            while (open_ := low < high).any():
                mid = (low + high) // 2
                one = (values[np.minimum(mid, len(values) - 1)] >> shift & np.uint64(1)).astype(bool)
                high = np.where(open_ & one, mid, high)
                low = np.where(open_ & ~one, mid + 1, low)
            lo = np.column_stack([a, low]).ravel()
            hi = np.column_stack([low, b]).ravel()
        for k, v in parts.items():
            setattr(self, k, np.concatenate(v) if v else np.zeros(0, np.int64))


class Forest:
    """Union-find over positions; ``same`` tells if whole ranges are one known component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._steps()

    def _steps(self) -> None:
        self.steps = np.cumsum(np.r_[False, self.label[1:] != self.label[:-1]]) if len(self.label) else self.label

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        if not (new := a != b).any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in zip(a[new].tolist(), b[new].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.arange(len(self.label))
        keys = list(parent)
        root[keys] = [find(x) for x in keys]
        self.label = root[self.label]
        self._steps()

    def same(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        s, n = self.steps, self.label
        return (n[lo1] == n[lo2]) & (s[hi1 - 1] == s[lo1]) & (s[hi2 - 1] == s[lo2])


def link_forest(values: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each value the smallest position of its component inside its group.

    ``values`` are distinct and sorted inside each run of equal ``group``.  Node pairs whose
    values are already one component need no further walk: no new class can come from them.
    """
    trie, forest = Trie(values, group), Forest(len(values))
    lo, hi, bit, left = trie.lo, trie.hi, trie.bit, trie.left
    roots = np.flatnonzero(bit[: trie.roots] >= 0)
    stack = [(roots, roots)]
    while stack:
        a, b = stack.pop()
        if len(a) > CHUNK:
            stack += [(a[:-CHUNK], b[:-CHUNK])]
            a, b = a[-CHUNK:], b[-CHUNK:]
        own = a == b
        same, a, b = a[own], a[~own], b[~own]
        if len(a):
            top = np.maximum(bit[a], bit[b])
            differ = values[lo[a]] ^ values[lo[b]]
            # the bits above both branches are the same for all values below the two nodes
            fixed = np.where(top < 63, differ >> np.minimum(top + 1, 63).astype(np.uint64), np.uint64(0))
            keep = np.bitwise_count(fixed) <= budget
            a, b, top = a[keep], b[keep], top[keep]
            keep = ~forest.same(lo[a], hi[a], lo[b], hi[b])
            a, b, top = a[keep], b[keep], top[keep]
            leaves = top < 0
            if leaves.any():
                forest.join(lo[a[leaves]], lo[b[leaves]])
                a, b = a[~leaves], b[~leaves]
            if len(a):
                swap = bit[a] < bit[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                stack.append((np.concatenate([left[a], left[a] + 1]), np.concatenate([b, b])))
        same = same[bit[same] >= 0]
        if len(same):
            one, two = left[same], left[same] + 1
            stack.append((one, two))
            stack.append((np.concatenate([one, two]), np.concatenate([one, two])))
    return forest.label


#: Values that are walked at once: whole shards, at most this many and one shard more.
WALKED = 1 << 17


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the shards that come, in order of mask, key and value.

    A task holds the shards that it walks, not all of its rows."""
    held: list[np.ndarray] = []  # columns mask, key, value
    size = 0
    for b in batches:
        held.append(np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("mask", "key", "value")]))
        size += len(held[-1])
        if size > WALKED:
            rows = np.concatenate(held)
            # the last shard may go on
            whole = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1)).max(initial=-1)) + 1
            if whole:
                yield _links(rows[:whole])
            held, size = [rows[whole:]], len(rows) - whole
    if size:
        yield _links(np.concatenate(held))


def _links(rows: np.ndarray) -> pa.RecordBatch:
    mask, key, value = rows.T
    unsigned = np.ascontiguousarray(value).view(np.uint64)
    order = np.lexsort((unsigned, key, mask))
    mask, key, unsigned = mask[order], key[order], unsigned[order]
    group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    label = link_forest(unsigned, group)
    linked = label != np.arange(len(label))
    signed = unsigned.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], ["a", "b"])


def _shards(values: DataFrame, max_shard: int) -> DataFrame:
    """``(value)`` -> ``(mask, key, value)``, each value once for each shard it is in."""

    def dealt(df: DataFrame, level: int, parent: str | None) -> DataFrame:
        masks = [
            F.struct(F.lit(i).alias("mask"), (F.col("value").bitwiseAND(F.lit(_signed(m)))).alias("key"))
            for i, (m, _) in enumerate(MASKS[level])
        ]
        if parent is not None:
            per = len(MASKS[level]) // len(MASKS[level - 1])
            chosen = F.slice(F.array(*masks), F.col(parent) * per + 1, per)
        else:
            chosen = F.array(*masks)
        return df.select("value", F.inline(chosen))

    out, now, level = None, dealt(values, 0, None), 0
    while True:
        sizes = materialize(now.groupBy("mask", "key").count().where(F.col("count") > max_shard), "hot-shards")
        tag = [F.lit(level * 1000).alias("level")]
        if level + 1 == len(MASKS) or sizes.isEmpty():
            done = now.select((F.col("mask") + tag[0]).alias("mask"), "key", "value")
            return done if out is None else out.union(done)
        cool = now.join(sizes, ["mask", "key"], "left_anti")
        cool = cool.select((F.col("mask") + tag[0]).alias("mask"), "key", "value")
        out = cool if out is None else out.union(cool)
        hot = now.join(sizes, ["mask", "key"], "left_semi").withColumnRenamed("mask", "up")
        level += 1
        now = dealt(hot, level, "up")


def _classes(prints: DataFrame, max_shard: int) -> DataFrame:
    """``prints(doc_id, value)``, a written table -> (value, class, component_id): the class's
    smallest fingerprint, as a signed number, and smallest doc_id."""
    spark = prints.sparkSession
    values = materialize(prints.groupBy("value").agg(F.min("doc_id").alias("rep")), "values")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _shards(values.select("value"), max_shard).repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "value")
    roots = materialize(connected_components(dealt.mapInArrow(_shard_links, "a long, b long")), "classes")
    known = values.join(roots, values.value == roots.id, "left").select("value", "rep", F.coalesce("component", "value").alias("class"))
    # only values that are linked have a smallest id to look for
    linked = known.join(roots.select(F.col("id").alias("value")), "value", "left_semi")
    least = linked.groupBy("class").agg(F.min("rep").alias("least"))
    return known.join(least, "class", "left").select("value", "class", F.coalesce("least", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``, a row per input row.

    Fingerprints at three or fewer differing bits are linked; ``component_id`` is the smallest
    doc_id reachable, the document's own included.  Documents without words share fingerprint 0
    and are linked like any other.  A null doc_id is carried along, is never a representative,
    and has a null component only if no document with an id is reachable.  Repeated rows stay;
    rows with one id and other texts are documents of their own.  Ids may be of any type that has
    an order.
    """
    prints = materialize(docs.select("doc_id", fingerprint("text").alias("value")), "fingerprints")
    of_value = _classes(prints, max_shard).select("value", "component_id")
    return prints.join(of_value, "value", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, as it is: the one with the smallest id, of rows with that id
    and other texts the one with the smallest text hash, of equal ones any.

    Documents without an id can't be chosen between and stay.  Ids and hashes alone are compared;
    texts move only to be told apart from the rows that go.
    """
    mark, count = unused(docs, "_hash", "_n")
    key = F.xxhash64("text")
    prints = materialize(docs.where("doc_id is not null").select("doc_id", key.alias("_hash"), fingerprint("text").alias("value")), "fingerprints")
    rows = prints.join(_classes(prints, MAX_SHARD), "value")
    chosen = materialize(rows.groupBy("class").agg(F.min(F.struct("doc_id", "_hash")).alias("_first")), "chosen")
    told = rows.join(chosen, "class").groupBy("doc_id", "_hash").agg(
        F.max(F.struct("doc_id", "_hash") == F.col("_first")).alias("_kept"), F.count("*").alias("_n")
    )
    told = materialize(told.where("not _kept or _n > 1").select(F.col("doc_id"), F.col("_hash").alias(mark), F.when(F.col("_kept"), F.col("_n")).alias(count)), "gone")
    hashed = docs.withColumn(mark, key)
    out = hashed.join(told, ["doc_id", mark], "left_anti").select(*docs.columns)
    again = told.where(F.col(count).isNotNull())
    if again.isEmpty():
        return out
    return out.unionByName(hashed.join(again, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
