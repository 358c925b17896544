"""Importance resampling: SQL, plain Python, and ranks of many runs with ties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from feedloom.llm import resampling as R
from tests.llm.oracle import same


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def buckets(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % R.BUCKETS for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text, longest))
    for text in target:
        t.update(buckets(text, longest))
    all_s, all_t, k = sum(s.values()), sum(t.values()), R.BUCKETS
    out = []
    for i, text in docs:
        b = buckets(text, longest)
        gain = [math.floor(1000 * math.log((t[x] + 1.0) * (all_s + float(k)) / ((s[x] + 1.0) * (all_t + float(k))))) for x in b]
        weight = sum(gain) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 10 // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_brute_force(spark, longest):
    rng = random.Random(longest)
    docs = [(i, " ".join(rng.choice(["The", "cat", "sät", "on", "a", "mat", "x1", "--", "日本"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,"), (None, "cat " * 40), (303, "a " * 50_000), (5, docs[5][1]), (5, docs[5][1])]
    target = ["the cat sat", None, "", "mat mat x1"]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.importance_ranks(df, to, longest=longest).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, longest)


@pytest.mark.parametrize("samples,segments", [(10, 4), (65536, 7), (200, 1)])
def test_ranks(spark, monkeypatch, samples, segments):
    """A third of all rows share one score; runs of very different sizes."""
    monkeypatch.setattr(R, "SAMPLES", samples)
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(-50, 50), i) for i in range(4000)] + [(7, None), (7, None)]
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(6, "score")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for most in (0, 1, 1500, len(rows)):
        got = R.exact_ranks(df, most, segments).collect()
        assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, most + 1))
        assert all(order[r["rank"] - 1] == (r.score, r.doc_id) for r in got if r["rank"])


def test_empty_tables_and_drawn_rows(spark):
    none, kind = spark.createDataFrame([], "doc_id long, text string"), "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, "good words " * 15, "en") for i in range(20)], kind)
    assert R.importance_ranks(none, docs).count() == 0
    assert R.importance_ranks(docs, none).where("rank is not null").count() == 2
    drawn = R.resampled(docs, docs, percent=50)
    assert drawn.columns == docs.columns and drawn.count() == 10


def test_against_sql(spark, sf_dir):
    same(R.op12_importance_resampling(spark, sf_dir), R.OP12_SQL, sf_dir)
