"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from feedloom.llm import simhash as S
from feedloom.llm.components import connected_components


def slow_simhash(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, budget=3):
    """Smallest index reachable, by all pairs."""
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


TEXTS = [None, "", "  \n\t ", "one", "One two", "ONE  two\tthree", "a b c d", "a b c d a b c d", "É é \x85 x\xa0y z", "word " * 4000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.simhash(None if text is None else text.encode()) == slow_simhash(text)


@pytest.mark.parametrize("seed,bits", [(0, 64), (1, 10), (2, 7), (3, 20)])
def test_trie_walk_finds_the_classes(seed, bits):
    rng = random.Random(seed)
    base = [rng.getrandbits(bits) for _ in range(40)]
    values = {b ^ sum(1 << rng.randrange(bits) for _ in range(rng.randrange(5))) & (1 << bits) - 1 for b in base * 8}
    values = np.array(sorted(values), np.uint64)
    group = np.zeros(len(values), int)
    assert S.link_forest(values, group).tolist() == classes([int(v) for v in values])


def test_chunked_walk(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 3)
    values = np.arange(0, 400, 3).astype(np.uint64)
    assert S.link_forest(values, np.zeros(len(values), int)).tolist() == classes([int(v) for v in values])


def test_groups_are_apart():
    values = np.array([1, 2, 1, 2, 0xFF << 40], np.uint64)
    assert S.link_forest(values, np.array([0, 0, 1, 1, 1])).tolist() == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("max_shard", [S.MAX_SHARD, 5])
def test_near_duplicates(spark, max_shard):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(50)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(120)]
        for k in range(rng.randrange(1, 4)):
            rows.append((100 + len(rows), " ".join(words)))
            words[rng.randrange(120)] = "changed"
    rows += [(rows[-1]), (None, "a b c d"), (None, "no other text is like this one")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, value string, rep long")
    got = sorted(S.near_duplicates(docs, max_shard).collect(), key=str)
    prints = [slow_simhash(t) for _, t in rows]
    label = classes(prints)
    ids = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            ids[c] = min(i, ids.get(c, i))
    want = sorted(((i, f"{p:016x}", ids.get(c)) for (i, _), p, c in zip(rows, prints, label)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []


def test_components_of_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, i) for i in range(1001, 1100)]
    odd = [(5, 5), (None, 3), (7000, 7000)]
    got = connected_components(spark.createDataFrame(path + star + odd, "a long, b long")).collect()
    assert dict(got) == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1100)}


def test_one_of_each(spark):
    rows = [(3, "a b c d", 1), (2, "A b c d", 2), (2, "A b c d", 2), (9, "quite another text", 3), (None, "a b c d", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r[2] for r in got.collect())) == [2, 3, 4, 5]


def test_one_id_with_other_texts(spark):
    """Rows are documents: b is not lost, a stands once; columns of the operator's names stay."""
    a, b = "first text of all of them here", "something quite different stands in this one"
    rows = [(1, a, 0, "p"), (5, a, 1, "q"), (5, b, 2, "r"), (5, b, 2, "r"), (7, b + " ", 3, "s"), (None, b, 4, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int, _n string")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", "a b c d"), ("m", "A b c d"), ("z", "other words stand here now")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()} == {"x": "m", "m": "m", "z": "z"}
    assert {r.doc_id for r in S.one_of_each(docs).collect()} == {"m", "z"}


@pytest.mark.parametrize("walked", [1, 7, 1 << 17])
def test_shards_in_any_batches(monkeypatch, walked):
    """A task's links do not depend on where batches end or how many shards are walked at once."""
    import pyarrow as pa

    monkeypatch.setattr(S, "WALKED", walked)
    rng = np.random.default_rng(4)
    rows = np.unique(np.column_stack([rng.integers(0, 3, 300), rng.integers(0, 4, 300), rng.integers(0, 256, 300)]), axis=0)
    make = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["mask", "key", "value"])
    want = set(zip(*(c.to_pylist() for c in S._links(rows).columns)))
    for size in (1, 13, 1000):
        got = S._shard_links(make(rows[k : k + size]) for k in range(0, len(rows), size))
        assert {x for b in got for x in zip(*(c.to_pylist() for c in b.columns))} == want
