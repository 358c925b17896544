"""Quality rules against plain Python, the threshold and separation on made texts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm import ngramratio as Q
from tests.llm.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[0-9A-Za-z_\x80-\U0010FFFF]+|[^0-9A-Za-z_\x09-\x0D\x20\x80-\U0010FFFF]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {p for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def buckets(text):
    h = [zlib.crc32(t.encode()) for t in TOKEN.findall(text or "")]
    return [x % Q.BUCKETS for x in h] + [(Q.PAIR * a + b) % Q.BUCKETS for a, b in zip(h, h[1:])]


TEXTS = [None, "", "  \n\t", "a", "a b", "a a a a a", "é b | c\n\nc\nc\n \n \nc", "x\x0by\x0cz\rq", "a b c a b c a b c", "# * $ % & | < > #", "日本 語 日本 語 日本 語", "a\x00b \x1fc", "w " * 3000]


def rows(seed, n=60):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(["a", "b", "the", "é", "##", "&", "\n", " ", " ", "\t", "_x"]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def test_base_counts(spark):
    texts = rows(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in df.select("doc_id", *(c.alias(n) for n, c in Q.base_counts(F.col("text")).items())).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_repeats_of_colliding_hashes(spark, monkeypatch):
    """With all hashes alike the words themselves decide."""
    monkeypatch.setattr(Q.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    texts = rows(2, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(Q.WORD), F.lit(0))
    assert {i: n for i, n in df.select("i", Q.repeated_words(words)).collect()} == {i: base(t)[4] for i, t in enumerate(texts)}


def brute(docs, labels):
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = min(good.get(i, 1), q)
    held = {i for i in good if zlib.crc32(str(i).encode()) % Q.HELD == 0}
    s, t = Counter(), Counter()
    for i, text in docs:
        s.update(buckets(text))
        if good.get(i) == 1 and i not in held:
            t.update(buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + float(Q.BUCKETS)) / ((s[b] + 1.0) * (all_t + float(Q.BUCKETS))))) for b in s}
    judged = []
    for i, text in docs:
        b, (n, _, _, _, again) = buckets(text), base(text)
        judged.append((i, sum(gain[x] for x in b) // len(b) if b else None, n < 50 or 100 * again > 50 * n))
    asked = sorted((s, good[i]) for i, s, failed in judged if i in held and not failed)
    best, least = None, None
    kinds = Counter(g for _, g in asked)
    for low, high in zip(sorted({s for s, _ in asked}), sorted({s for s, _ in asked})[1:]):
        below = Counter(g for s, g in asked if s < high)
        j = below[0] * kinds[1] - below[1] * kinds[0]
        if j > 0 and kinds[0] * kinds[1] and (best is None or (j, high - low, -high) > best):
            best, least = (j, high - low, -high), low + (high - low + 1) // 2
    return sorted((i if i is not None else -1, s, failed, not failed and (least is None or s >= least)) for i, s, failed in judged)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(160):
        bad = i % 5 == 1
        text = " ".join(rng.choice(vocabulary) + (rng.choice(["###", "&&&"]) if bad else "") for _ in range(rng.randrange(20, 120)))
        docs.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    docs += [(160, None), (161, ""), (162, "!!! " * 80), (None, docs[0][1]), (3, docs[3][1]), (3, docs[1][1])]
    labels += [(None, 1), (7, None), (4, 0), (4, 1), (9999, 1)]
    return docs, labels


def test_whole_query(spark, made):
    docs, labels = made
    # columns of clashing names are left alone
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    got = Q.quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.score, r.base_failed, r.kept) for r in got) == brute(docs, labels)
    kept = {r.doc_id for r in got if r.kept and r.doc_id is not None and r.doc_id not in (3, 4)}
    passing = {r.doc_id for r in got if not r.base_failed and r.doc_id is not None and r.doc_id not in (3, 4)}
    assert kept == {i for i in passing if i % 5 != 1 and i < 160}


def test_without_labels_all_passing_rows_are_kept(spark, made):
    docs, _ = made
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()
    assert len(got) == len(docs) and all(r.kept != r.base_failed for r in got)
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_all_labels_are_fitted(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    got = Q.labelled(labels).agg(F.count("*"), F.count_if("good"), F.count_if("held")).first()
    assert tuple(got) == (60_000, 40_000, sum(zlib.crc32(str(i).encode()) % Q.HELD == 0 for i in range(60_000)))


def test_against_sql(spark, sf_dir):
    same(Q.op11_quality_rules(spark, sf_dir), Q.OP11_SQL, sf_dir)


def test_words_are_worked_out_once(spark):
    """A text's words are one expression of the plan, however many counts need them."""
    docs = spark.createDataFrame([(1, "a b c a b c d"), (2, None), (3, "")], "doc_id long, text string")
    out = Q.scored(docs, [0] * 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # words and tokens
    assert [tuple(r)[1:] for r in out.orderBy("doc_id").collect()] == [(7, 7, 0, 0, 6, 0), (0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, None)]
