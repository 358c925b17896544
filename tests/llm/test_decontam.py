"""Decontamination: the index against plain search, and the query against SQL."""

import random

import numpy as np
import pytest

from feedloom.llm import decontam as D
from tests.llm.oracle import same


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_place(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 9))
    text = rng.integers(1, top + 1, int(rng.integers(1, 300)))
    index = D.FMIndex(text, top, sample=int(rng.integers(1, 9)))
    for n in (1, 2, 3, 5):
        patterns = rng.integers(1, top + 1, (40, n))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, bench, width):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if (own := windows.get(tuple(w[k : k + n]))) and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    items |= own
        out.append((doc, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocab = ["a", "B", "ñ", "c1", "ünd", "zz"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, line(rng.randrange(1, 9))) for i in range(25)] + [(77, None), (78, "-- !!"), (None, "zz zz zz"), (3, "ñ-Ñ.ñ")]
    docs = [(i, line(rng.randrange(0, 60))) for i in range(50)] + [(100, None), (101, "?!"), (102, "the " * 3000), (103, "x" + " a" * 5000), (None, "zz ZZ, zz"), (1, "zz zz zz")]
    d = spark.createDataFrame([(*r, "h") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, doc_id int")
    got = D.with_hits(d, b, width=5, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.hits.n_words, r.hits.n_hit, sorted(r.hits["items"])) for r in got), key=str) == brute(docs, bench, 5)
    assert all(sum(s.after - s.first for s in r.hits.spans) == r.hits.n_hit for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.with_hits(docs, none).first().hits.n_hit == 0
    assert D.with_hits(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    assert D.decontaminated(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "z", "y", 2), (3, None, "n", 3), (None, "q", "o", 4)], "doc_id long, text string, _hits string, __HITS int")
    out = D.decontaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(2, "z", "y", 2), (3, None, "n", 3), (None, "q", "o", 4)], key=str)


def test_a_part_at_a_time(spark):
    """Each part has at most about its bytes, and all windows are in one of them."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40))) for k in range(200)]
    b = spark.createDataFrame(rows, "item_id long, text string")
    paths = D.stored_phrases(b, 13, 2000)
    loaded = [D._load(p) for p in paths]
    assert len(D._loaded) == 1 and len(paths) == -(-sum(len(t) for _, t in rows) // 2000)
    got = {tuple(p.words[i - 1] for i in w) for p in loaded for w in p.windows.get(13, [])}
    assert got == {tuple(x.encode() for x in t.split()[k : k + 13]) for _, t in rows for k in range(28)}
    assert max(sum(len(p.owners[n][1]) for n in p.owners) for p in loaded) < 28 * 200 / len(paths) * 2


def test_oracle(spark, sf_dir):
    same(D.op1_benchmark_decontamination(spark, sf_dir), D.OP1_SQL, sf_dir)
