"""Ranked search against plain scoring of all documents for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical as L
from tests.llm.oracle import same


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(80)] + ["É", "the", "THE", "x-y", "日本"]
    draw = lambda most: " ".join(words[min(len(words) - 1, int(rng.expovariate(0.06)))] for _ in range(rng.randrange(0, most)))
    docs = [(i, draw(60)) for i in range(n)]
    docs += [(n + k, docs[7][1] + " w3 w9") for k in range(150)]  # many copies: long ties
    docs += [(None, "w3 w9 w1"), (-1, None), (-2, ""), (-3, " ..."), (5, docs[5][1]), (9999, "w3 " * 100_000)]
    items = [(k, draw(12)) for k in range(30)] + [(90, "w3 w9 w9"), (91, None), (92, ""), (93, "unknown"), (94, "the " * 50), (90, "w3 w9 w9")]
    return docs, items


@pytest.mark.parametrize("coordinates,at_once,block,postings", [(4096, 1024, 200_000, 4_000_000), (3, 64, 20, 500), (1, 7, 1, 1)])
def test_brute_force(spark, monkeypatch, coordinates, at_once, block, postings):
    """Small sketches, blocks and loads give the same rows: bounds only order the work."""
    for name, value in (("COORDINATES", coordinates), ("AT_ONCE", at_once)):
        monkeypatch.setattr(L, name, value)
    docs, items = corpus(1)
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(w for _, c in counted for w in c)
    blocks = [L.Block()]
    for q, (item, text) in enumerate(items):
        found = [{"term": w, "weight": math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))} for w in sorted(set(terms(text))) if w in df]
        blocks[-1].add(q, item, found)
        if blocks[-1].size >= block:
            blocks.append(L.Block())
    rows, load = [], L.Postings()
    for i, c in [*counted, (None, None)]:
        if c:
            load.add(i, sum(c.values()), [(w.encode(), k) for w, k in c.items()])
        if load.size >= postings or c is None:
            for b in blocks:
                rows += L.best_of(load, b, n, total, 10) if load.ids else []
            load = L.Postings()
    best = []
    for q, (item, _) in enumerate(items):
        own = sorted((-s, i is None, i or 0, i) for k, _, i, s in rows if k == q)[:10]
        best += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(own)]
    assert sorted(best, key=str) == brute(docs, items)


def test_query(spark):
    docs, items = corpus(2)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, rank string").repartition(5)
    got = L.search(df, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_bits_hold_every_term(spark):
    words = ["w%d" % k for k in range(3000)]
    bits = L.term_bits(spark.createDataFrame([(w,) for w in words], "term string"))
    assert L.has_bit(bits, [w.encode() for w in words]).all()
    assert np.mean(L.has_bit(bits, [b"z%d" % k for k in range(3000)])) < 0.02


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(none, one).count() == 0
    assert L.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), one.limit(0)).count() == 0


def test_against_sql(spark, sf_dir):
    same(L.op13_ranked_lexical_search(spark, sf_dir), L.OP13_SQL, sf_dir)
