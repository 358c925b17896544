"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a block of documents, in sorted order, are a depth-first walk of their
trie: what two neighbours share is a prefix on the path, whose forward scores stay.  Only the new
characters' scores are computed, and each pre-token's count of pieces is stored where it ends.

The pieces come from a vocabulary file, whose tokenizer is not trained.  Their scores are a
unigram model's, log((n + 1) / (N + V)), with the number n of times that a piece stands in the
best segmentations of all the corpus; those are made with Zipf's -log((r + 1) * log(V)) for the
piece ranked r.  A character that is no piece falls back to its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import table

SPACE = "▁"
#: Bytes of counted pre-tokens that a worker keeps, what one takes beside its letters, letters of
#: the longest that is kept, and characters of a block of documents.
CACHE, ENTRY, KEPT, BLOCK = 96 << 20, 120, 64, 4 << 20
BLANKS = "\n\t\r\v\f"


def _blanks(text: str) -> str:
    """White space (tab to carriage return) as spaces."""
    for c in BLANKS:
        text = text.replace(c, " ")
    return text


class Unigram:
    """Piece scores and counts of best segmentations.

    ``uses`` has how often each piece stands in the corpus; without it scores are Zipf's.  Of equal
    scores the segmentation with fewer pieces wins.
    """

    def __init__(self, pieces: list[str], uses: list[int] | None = None):
        self.pieces = pieces
        if uses is None:
            scale = math.log(max(3, len(pieces)))
            self.score = {p: -math.log((r + 1) * scale) for r, p in enumerate(pieces)}
        else:
            total = sum(uses) + len(pieces)
            self.score = {p: math.log((n + 1) / total) for p, n in zip(pieces, uses)}
        self.longest = max(map(len, self.score), default=1)
        self.byte = min(self.score.values(), default=0.0) - 10
        self.counts: dict[str, int] = {}
        self.size = 0

    @classmethod
    def load(cls, path: str, uses: list[int] | None = None) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        return cls([model.id_to_piece(k) for k in plain], uses)

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """The trie of the words, depth first: each word where it ends, with the piece counts of
        its prefixes and where the last piece of each begins."""
        get, longest = self.score.get, self.longest
        best, pieces, back, before = [0.0], [0], [0], ""
        for word in sorted(words):
            path = SPACE + word
            shared, limit = 0, min(len(path), len(before))
            while shared < limit and path[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                top, few, at = None, 0, end - 1
                for start in range(max(0, end - longest), end):
                    own = get(path[start:end])
                    if own is not None:
                        own += best[start]
                        if top is None or own > top or (own == top and pieces[start] + 1 < few):
                            top, few, at = own, pieces[start] + 1, start
                if top is None:
                    size = len(path[end - 1].encode("utf-8", "surrogatepass"))
                    top, few = best[end - 1] + size * self.byte, pieces[end - 1] + size
                best.append(top)
                pieces.append(few)
                back.append(at)
            yield word, pieces, back
            before = path

    def learn(self, words: set[str]) -> None:
        """Counts for pre-tokens, one walk for all of them."""
        for word, pieces, _ in self.walk(words):
            self.counts[word] = pieces[-1]

    def uses(self, words: dict[str, int]) -> np.ndarray:
        """How often each piece stands in the best segmentations of words that occur so often."""
        number = {p: k for k, p in enumerate(self.pieces)}
        out = np.zeros(len(self.pieces), np.int64)
        for word, _, back in self.walk(words):
            path, n = SPACE + word, words[word]
            end = len(path)
            while end:
                k = number.get(path[back[end] : end])
                if k is not None:
                    out[k] += n
                end = back[end]
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, pieces) of each text.  Blank and null texts have none.

        Counted pre-tokens stay for later texts, but for long ones, in bounded memory.
        """
        if self.size > CACHE:
            self.counts.clear()
            self.size = 0
        split = [[w for w in _blanks(t or "").split(" ") if w] for t in texts]
        missing: set[str] = set()
        missing.update(*split)
        missing.difference_update(self.counts)
        self.learn(missing)
        get = self.counts.__getitem__
        out = [(len(words), sum(map(get, words))) for words in split]
        for w in missing:
            if len(w) > KEPT:
                del self.counts[w]
            else:
                self.size += ENTRY + len(w)
        return out


def _piece_uses(path: str):
    """Rows (word, n) -> (piece, n): a task's sums, so at most one row a piece."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = None, None
        for b in batches:
            model = model or Unigram.load(path)
            one = model.uses(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())))
            total = one if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    return of_task


def fitted(corpus: DataFrame, path: str) -> Unigram:
    """The model of ``corpus(text, ...)``: all its pre-tokens are counted, then the pieces of each
    distinct one.  The driver gets a number for each piece of the vocabulary."""
    text = F.translate("text", BLANKS, " " * len(BLANKS))
    words = corpus.where("text is not null").select(F.explode(F.split(text, " +")).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    sums = counted.mapInArrow(_piece_uses(path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = Unigram.load(path)
    uses = [0] * len(model.pieces)
    for r in sums.collect():
        uses[r.piece] = r.n
    return Unigram(model.pieces, uses)


#: A worker's last model.
_models: dict[tuple, Unigram] = {}
COUNT = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def counter(model: Unigram):
    """UDF: text -> (n_pretokens, n_tokens)."""
    pieces, score = model.pieces, np.array([model.score[p] for p in model.pieces])
    name = hash((tuple(pieces), score.tobytes()))

    @F.arrow_udf(COUNT)
    def count(text: pa.Array) -> pa.Array:
        if name not in _models:
            _models.clear()
            _models[name] = own = Unigram(pieces)
            own.score = dict(zip(pieces, score.tolist()))
            own.byte = min(own.score.values(), default=0.0) - 10
        out, block, size = [], [], 0
        for t in text:
            block.append(t := t.as_py())
            size += len(t or "")
            if size > BLOCK:
                out += _models[name].count(block)
                block, size = [], 0
        out += _models[name].count(block)
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], COUNT.fieldNames())

    return count


def with_token_counts(docs: DataFrame, path: str, name: str = "tokens", corpus: DataFrame | None = None) -> DataFrame:
    """Adds the struct ``name`` (n_pretokens, n_tokens) to ``docs(text, ...)``, with piece scores of
    ``corpus(text, ...)``, else of the documents themselves.

    Null, empty and blank texts count 0.  Pre-tokens are what stands between white space; no row
    moves, repeated rows get equal counts, and each adds to the scores.  With an empty corpus all
    pieces score alike, so the fewest pieces win.
    """
    return docs.withColumn(name, counter(fitted(docs if corpus is None else corpus, path))("text"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "tokens.*")
