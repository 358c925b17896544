"""Best-fit packing: against one-by-one placement and an exact round trip of the ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Remaining room of each bin after placing the lengths in turn."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if best is None:
            rooms.append(capacity)
            best = -1
        rooms[best] -= n
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_histogram_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 50, 64, 100])
    lengths = [rng.randint(1, rng.randint(1, capacity)) for _ in range(rng.randrange(1, 400))]
    count = Counter(lengths)
    runs, bins = P.best_fit_decreasing(count, capacity)
    used, offsets = Counter(), defaultdict(list)
    for k, (n, rank, first, per, offset) in enumerate(runs.tolist()):
        after = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else count[n]
        for i in range(after - rank):
            used[first + i // per] += n
            offsets[first + i // per].append((offset + i % per * n, n))
    assert Counter(capacity - used[b] for b in range(bins)) == one_by_one(lengths, capacity)
    for spans in offsets.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity


def test_runs_have_a_bound():
    rng = random.Random(1)
    count = {n: rng.randint(1, 10**6) for n in range(1, 4097)}
    runs, bins = P.best_fit_decreasing(count)
    assert len(runs) <= 2 * 4096 * 12
    assert bins >= -(-sum(n * c for n, c in count.items()) // 4096)


def test_impossible_length():
    with pytest.raises(ValueError):
        P.best_fit_decreasing({5: 1}, 4)


TEXTS = [
    None, "", " ", "Hello, World.", "it's. We'll see 12,5 a.b.", "x.,y ..", "ÉCOLE, Straße. ΣΑΣ. İst", "é ́x a\tb\x1cc\x85d e f",
    "<|endoftext|> and <|startoftext|>x", "a<|endoftext|>b,<|startoftext|><|endoftext|>. <|ENDOFTEXT|> don<|endoftext|>'t .<|endoftext|>", "Ñandú\nñandú.\n\n", "日本語 テキスト。", "Aa. aa, AA", "., .", "😀. a️,", "Àéî ÑÇ ÿ. µm ªº İı ſ ŉ ÅÅ ßẞ ǅ",
    "".join(chr(c) + " x" + chr(c) + "y " for c in range(0xA0, 0x180)), "w" * 300 + ".",
]


def test_ids_are_the_tokenizers():
    tk = Tokenizer.from_file(PATH)
    words = P.WordTokens(PATH)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(words.encode(t), "<u4").tolist() == tk.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("form", ["{}.", "x{},", "{}a {}"])
def test_every_character(form):
    """All characters up to U+2FFFF, alone, behind a letter and before a stop."""
    tk, words = Tokenizer.from_file(PATH), P.WordTokens(PATH)
    texts = [form.replace("{}", chr(c)) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for t, e in zip(part, tk.encode_batch(part, add_special_tokens=False)):
            assert words.encode(t) == np.array(e.ids, "<u4").tobytes(), ascii(t)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 500)
    words = P.WordTokens(PATH)
    first = [words.encode(t) for t in TEXTS]
    assert [words.encode(t) for t in TEXTS] == first


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 100_000)
    words = P.WordTokens(PATH)
    rng = random.Random(3)
    for _ in range(50):
        words.encode(" ".join("".join(rng.choice("abcde") for _ in range(rng.choice([3, 9, 20, 4000]))) for _ in range(40)))
        held = sum(len(k) + len(v) for k, v in words.items())
        assert held < 2 * P.CACHE and max(map(len, words)) <= P.KEPT


@pytest.mark.parametrize("capacity", [4096, 16])
def test_pack_documents(spark, sf_dir, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6 + i, t, "x") for i, t in enumerate(TEXTS)] + [(10**6, None, "x"), (None, "no id", "x")], docs.schema)
    docs = docs.union(odd).cache()
    got = P.pack_documents(docs, PATH, capacity).collect()
    tk = Tokenizer.from_file(PATH)
    want = Counter((r.doc_id, tuple(tk.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id != 10**6:
            pieces[r.doc_id].append((r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for doc, parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(len(p[2]) == capacity for p in parts[:-1])
        assert [p[1] for p in parts] == [capacity * k for k in range(len(parts))]
        assert (doc, tuple(x for p in parts for x in p[2])) in want
    assert len(pieces) == len({d for d, _ in want}) - 1
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert sum(one_by_one([r.length for r in got], capacity).values()) == len(bins)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(docs, PATH).collect() == []


def test_ids_are_not_shuffled(spark, sf_dir):
    """The rows with ids are read and written where they are, and no order of rows changes a place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = P.pack_documents(docs.repartition(3), PATH, 64)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    one, other = ({(r.doc_id, r.piece): r for r in x.collect()} for x in (out, P.pack_documents(docs.repartition(5, "doc_id"), PATH, 64)))
    assert one == other and len(one) > docs.count()
    narrow = {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in P.pack_documents(docs, PATH, 64, keep_ids=False).collect()}
    assert narrow == {k: (r.sequence_id, r.offset) for k, r in one.items()}


def test_words_in_capitals_and_before_marks_are_looked_up():
    """Neither case nor marks behind a word make it a chunk of its own for the tokenizer; special tokens,
    contractions and letters beyond Latin-1 keep the tokenizer's ids."""
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, []

        def encode(self, chunk, **how):
            self.asked.append(chunk)
            return self.tokenizer.encode(chunk, **how)

    words = P.WordTokens(PATH)
    plain = words.tokenizer
    ids = lambda t: P.array("I", plain.encode(t, add_special_tokens=False).ids).tobytes()
    words.tokenizer = counted = Counted(plain)
    text = "Straße STRASSE$$$ straße.*** Été### été&&&! word's. WORD'S"
    assert words.encode(text) == ids(text)
    assert not {"strasse$$$", "straße.***", "été###", "été&&&!"} & set(counted.asked)
    assert "WORD'S" not in counted.asked and "Été" not in words
    for t in ("A<|ENDOFTEXT|>b.", "a<|endoftext|>B$$", "N̸=$ İ.,", "'Re$$ L'Été!? —A.", "x>|<. Ab|>", "µM. ª$ 3.5$"):
        assert words.encode(t) == ids(t), t
