"""Best-fit-decreasing packing of token sequences.

Lengths are integers up to the capacity, so documents of one length are interchangeable: the
best-fit-decreasing result is decided on the histogram of lengths (at most ``capacity`` rows),
with a segment tree over the remaining capacities that finds the tightest open bin in
logarithmic time, and holds for any number of documents.  The plan is a list of runs
"documents ranked a..b of this length go to the bins from c on".  A bin's remainder at least
halves each time a length touches it, so there are at most about ``2 * capacity *
log2(capacity)`` runs whatever the corpus.  Spark then ranks the pieces inside their length and
looks each one up.  Ids stay where they were written: the rows that are ranked are narrow, and a
written task's places come back to it as a file of the shared folder.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import materialize, new_path, open_shared, release, table

CAPACITY = 4096
END_ID = 1
#: Bytes of a worker's word cache before it starts anew, what an entry takes beside its letters,
#: and letters of the longest chunk that is kept.
CACHE, ENTRY, KEPT = 40 << 20, 200, 64
#: Texts that are cut at once, and bytes of ids after which they are handed on.
ROWS, IDS = 64, 1 << 20
#: Byte-level BPE's letter for each byte: itself if printable Latin-1, else from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = [chr(b) if b in _PLAIN else chr(256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)]

#: Marks that are a token run of their own behind a letter; an apostrophe may begin a contraction, and
#: the three of special tokens are left to the tokenizer.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<|>")

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)
#: The task that wrote a piece, and the piece's number in it.
AT = ("_task", "_no")


class WordTokens(dict):
    """Token ids of chunks between spaces, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins characters across it, so a text's ids are
    its chunks' ids in turn.  A chunk is tokenized when it is first asked for.  What is kept is
    bounded in bytes; longer chunks are tokenized each time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = 0

    def __missing__(self, chunk: str) -> bytes:
        # a letter below U+0130 and the marks behind it are always tokens apart; later ones may come
        # apart, and their mark would join the others
        front = chunk.rstrip(MARKS)
        if len(front) < len(chunk) and front[-1:].isalpha() and front[-1] < "\u0130":
            ids = self[front] + self[chunk[len(front) :]]
        elif chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0130"):
            # letters below U+0130 are one run, lower-cased one by one and never composed:
            # straight to the model, in its spelling of bytes
            word = chunk.lower()
            if word != chunk:
                ids = self[word]
            else:
                if not word.isascii():
                    word = "".join([BYTE_LETTERS[b] for b in word.encode()])
                ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= KEPT:
            self[chunk] = ids
            self.size += ENTRY + len(ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        if self.size > CACHE:
            self.clear()
            self[""], self.size = b"", 0
        text = (text or "").replace("\n", " ")
        # letters of Latin-1 are lower-cased one by one, so that may be done at once; not where it could
        # make a special token
        if "<|" not in text and _latin(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split(" ")))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _piece_arrays(texts: pa.Array, encode, capacity: int, keep_ids: bool) -> Iterator[pa.Array]:
    """Lists of pieces of the texts, in parts of bounded size."""
    end = array("I", [END_ID]).tobytes()

    def part() -> pa.Array:
        columns = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(ids, pa.binary())]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(columns, PIECES.elementType.fieldNames()))

    at, number, start, length, crc, ids, size = [0], [], [], [], [], [], 0
    for t in texts:
        got = encode(t.as_py()) + end
        for k, lo in enumerate(range(0, len(got), 4 * capacity)):
            one = got[lo : lo + 4 * capacity]
            number.append(k)
            start.append(lo // 4)
            length.append(len(one) // 4)
            crc.append(zlib.crc32(one))
            ids.append(one if keep_ids else None)
        at.append(len(number))
        size += len(got)
        if len(at) > ROWS or size > IDS:
            yield part()
            at, number, start, length, crc, ids, size = [0], [], [], [], [], [], 0
    yield part()
    release()


def _cutter(tokenizer: str, capacity: int, keep_ids: bool):
    """Rows (doc_id, text) -> a row per piece.  A text's ids end with ``END_ID``; only what is
    longer than the capacity is cut.  A null text is an empty one.  The tokenizer and its words
    are the task's own and go with it, so a worker that is reused stays small."""
    names = [f for f in PIECES.elementType.fieldNames() if keep_ids or f != "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, done = None, TaskContext.get().partitionId(), 0
        for b in batches:
            words, at = words or WordTokens(tokenizer), 0
            for part in _piece_arrays(b.column("text"), words.encode, capacity, keep_ids):
                doc = b.column("doc_id").slice(at, len(part)).take(pc.list_parent_indices(part))
                at += len(part)
                columns = [doc, *part.flatten().flatten()[: len(names)]]
                if keep_ids:
                    columns += [pa.array(np.full(len(doc), task)), pa.array(np.arange(done, done + len(doc)))]
                    done += len(doc)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, *(AT if keep_ids else ())])
        del words
        release()

    return cut


class OpenBins:
    """Open bins by remaining capacity: runs of bin numbers, under a segment tree that tells
    which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at, self.any[self.size + room] = self.size + room, bool(self.runs[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._mark(room)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Takes out a run of the tightest bins with room for ``need``: (room, first, count)."""
        at = self.size + need
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        first, count = self.runs[room].pop()
        self._mark(room)
        return room, first, count


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, per bin, offset) in order of length and rank, and
    the number of bins.  Equal to placing every document in turn, longest first, into the
    tightest open bin."""
    bins, opened, runs = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            got = bins.take(length)
            if got is None:  # new bins; equal lengths fill each before the next is opened
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                room, first, count = got
            per = room // length
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            runs.append((length, rank, first, per, capacity - room))
            used = full * per + rest
            rank, left = rank + used, left - used
            bins.add(room - per * length, first, full)
            if rest:
                bins.add(room - rest * length, first + full, 1)
                full += 1
            bins.add(room, first + full, count - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), opened


PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _placer(runs: np.ndarray):
    @F.arrow_udf(PLACE)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        key = (runs[:, 0] << 46) | runs[:, 1]
        run = runs[np.searchsorted(key, (n << 46) | r, side="right") - 1]
        i, per = r - run[:, 1], run[:, 3]
        where = pa.array(run[:, 2] + i // per), pa.array(run[:, 4] + i % per * n)
        return pa.StructArray.from_arrays(where, ["sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(length, ...)``.

    ``pieces`` is read twice and must give the same rows both times (a written table).  Ranks
    inside a length are dealt over ``buckets`` hashed parts, so that one frequent length is
    spread; the parts' sizes (at most capacity x buckets rows) give each part its first rank.
    Ids and where a piece was written have no say in the ranks.
    """
    key = [c for c in pieces.columns if c not in ("ids", *AT)]
    buckets = buckets or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = pieces.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = hashed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    sizes = materialize(sizes, "length-counts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("length").alias("_length"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    inside = Window.partitionBy("length", "_part").orderBy(*key)
    ranked = hashed.withColumn("_row", F.row_number().over(inside) - 1).join(
        starts, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p"))
    )
    placed = ranked.withColumn("_at", _placer(runs)("length", F.col("_first") + F.col("_row")))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def _stored_places(placed: DataFrame) -> dict[int, str]:
    """``placed(_task, _no, sequence_id, offset)`` -> for each task the path of its places in order
    of ``_no``, 16 bytes each.  A row a task comes to the driver; one that is run again writes
    files of its own."""
    folder = new_path(placed.sparkSession, "places")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, path, to = None, None, None
        for b in batches:
            tasks = b.column("_task").to_numpy()
            places = np.stack([b.column(c).to_numpy() for c in ("sequence_id", "offset")], axis=1).astype("<i8")
            edges = np.r_[0, np.flatnonzero(np.diff(tasks)) + 1, len(tasks)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo and tasks[lo] != task:
                    if to is not None:
                        to.close()
                        yield pa.RecordBatch.from_pylist([{"_task": task, "path": path}], schema=kind)
                    task, path = int(tasks[lo]), f"{folder}/{uuid.uuid4().hex}"
                    to = open_shared(path, "w")
                if hi > lo:
                    to.write(places[lo:hi].tobytes())
        if to is not None:
            to.close()
            yield pa.RecordBatch.from_pylist([{"_task": task, "path": path}], schema=kind)

    kind = pa.schema([("_task", pa.int64()), ("path", pa.string())])
    files = placed.select(*AT, "sequence_id", "offset").repartition("_task").sortWithinPartitions(*AT)
    return {r[0]: r[1] for r in files.mapInArrow(write, "_task long, path string").collect()}


def _finder(paths: dict[int, str]):
    """UDF: a piece's task and number -> its place.  Pieces come in runs of neighbours, as they were
    written, and a run is one read."""

    @F.arrow_udf(PLACE)
    def find(task: pa.Array, no: pa.Array) -> pa.Array:
        tasks, numbers = task.to_numpy(), no.to_numpy()
        edges = np.r_[0, np.flatnonzero((np.diff(tasks) != 0) | (np.diff(numbers) != 1)) + 1, len(tasks)]
        found = [np.zeros((0, 2), "<i8")]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                with open_shared(paths[int(tasks[lo])], "r") as source:
                    source.seek(16 * int(numbers[lo]))
                    found.append(np.frombuffer(source.read(16 * int(hi - lo)), "<i8").reshape(-1, 2))
        places = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(places[:, k].astype(np.int64)) for k in (0, 1)], PLACE.fieldNames())

    return find


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row per piece: doc_id, piece, start, length, ids_crc32,
    ids (little-endian unsigned 32-bit integers; left out without ``keep_ids``), sequence_id,
    offset.

    Null and empty texts are one piece of the end id alone.  A special token's string in a text is
    that token, as the tokenizer has it.  Repeated rows are packed each; a null doc_id is kept.
    An empty table gives an empty table; further columns are left out.
    """
    fields = [f for f in PIECES.elementType.fields if keep_ids or f.name != "ids"]
    own = [T.StructField(c, T.LongType()) for c in AT] if keep_ids else []
    schema = T.StructType([docs.schema["doc_id"], *fields, *own])
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, capacity, keep_ids), schema), "pieces")
    if not keep_ids:
        return pack(pieces, capacity)
    paths = _stored_places(pack(pieces.drop("ids"), capacity))
    placed = pieces.withColumn("_at", _finder(paths)(*AT))
    return placed.select("doc_id", *(f.name for f in fields), "_at.sequence_id", "_at.offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
