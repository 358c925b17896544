"""Similar vectors: equal to all pairs, with few candidates on long texts, and blocks left out."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as T
from feedloom.operators import clusters as C
from feedloom.operators import similarity as S


def vectors(texts):
    v = np.zeros((len(texts), 256))
    for k, t in enumerate(texts):
        for b, n in C._bucketed(t).items():
            v[k, b] = n
    return v


def brute(texts, threshold):
    """The smallest id stands for equal counts; texts without tokens are on no pair."""
    v, out, first = vectors(texts), {}, {}
    for k in range(len(texts)):
        first.setdefault(v[k].tobytes(), k)
    kept = sorted(k for k in first.values() if v[k].any())
    u = v[kept] / np.linalg.norm(v[kept], axis=1)[:, None]
    cosine = u @ u.T
    for i, j in itertools.combinations(range(len(kept)), 2):
        if cosine[i, j] >= threshold - 1e-12:
            out[kept[i], kept[j]] = round(cosine[i, j], 9)
    return out


def long_texts(rng, n, words=150, vocabulary=5000):
    return [" ".join("w%d" % rng.randrange(vocabulary) for _ in range(words)) for _ in range(n)]


def edited(rng, text, share):
    return " ".join("z%d" % rng.randrange(5000) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("threshold,block,per_pivot", [(0.9, 2048, 4096), (0.5, 40, 30), (0.97, 64, 10)])
def test_brute_force(spark, monkeypatch, threshold, block, per_pivot):
    monkeypatch.setattr(S, "PER_PIVOT", per_pivot)
    rng = random.Random(int(threshold * 100))
    base = long_texts(rng, 40, 30, 300)
    texts = base + [edited(rng, rng.choice(base), 0.1) for _ in range(200)] + [base[0]] * 20 + ["", None, "...", "a", "a a", "A", "b a"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    monkeypatch.setattr(C, "pairs_over", lambda v, t, k: S.pairs_over(v, t, k, block))
    got = {(r.a, r.b): round(r.cosine, 9) for r in C.similarity_pairs(df, threshold).collect()}
    want = brute(texts, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_candidates_of_long_texts(spark):
    """2,000 texts of 150 words at 0.9: what the first bound lets through, and the whole result."""
    rng = random.Random(7)
    texts = long_texts(rng, 1900)
    texts += [edited(rng, texts[k], 0.05) for k in range(100)]
    v = vectors(texts)
    weight = ((v / np.linalg.norm(v, axis=1)[:, None]) ** 2).sum(axis=0)
    head, counted = np.sort(np.argsort(-weight)[: int(S.HEAD * 256)]), [0]
    found = sum(len(i) for i, _, _ in S.close_pairs(v, v, 0.9, True, head, counted))
    assert counted[0] < 0.05 * len(texts) * (len(texts) - 1) / 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b) for r in C.similarity_pairs(df, 0.9).collect()}
    assert got == brute(texts, 0.9).keys() and len(got) == found and {(k, 1900 + k) for k in range(100)} <= got


def test_blocks_of_far_clusters_are_left_out(spark, monkeypatch):
    """Texts of ten topics that share no word: blocks of different topics never meet."""
    monkeypatch.setattr(S, "PER_PIVOT", 20)
    rng = random.Random(3)
    # one bucket a word, so that topics are orthogonal
    rows = []
    for k in range(600):
        topic = k % 10
        counts = {topic * 25 + rng.randrange(25): rng.randrange(1, 4) for _ in range(12)} | {topic * 25: 30}
        rows.append((k, [(b, n) for b, n in sorted(counts.items())]))
    df = spark.createDataFrame(rows, "rep long, tf array<struct<bucket: int, n: int>>")
    pivots = S.pivots_of(df, 600, 256)
    blocks = S.stored_blocks(df, pivots, 50)
    n, near = blocks.count(), S.near_blocks(blocks, None, pivots, float(np.arccos(0.95))).count()
    assert sum(r.n for r in blocks.collect()) == 600 and near < 0.35 * n * (n + 1) / 2
    got = {(r.a, r.b) for r in S.pairs_over(df, 0.95, 256, 50).collect()}
    u = S.units(S.dense([[{"bucket": b, "n": c} for b, c in r] for _, r in rows], 256))
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))}


def test_nothing(spark):
    assert C.similarity_pairs(spark.createDataFrame([], "id string, text string"), 0.5).collect() == []
    assert C.similarity_pairs(spark.createDataFrame([("x", "..."), ("y", None)], "id string, text string"), 0.5).collect() == []


def components_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(k) for k in range(n)]


def test_links_of_clusters_are_a_forest(spark):
    """Texts that are all alike: a task hands on as many links as vectors at most, not all pairs, and
    the components are those of all pairs."""
    rng = random.Random(31)
    base = long_texts(rng, 3)
    texts = [edited(rng, base[k % 3], rng.choice([0.01, 0.03, 0.3])) for k in range(180)] + ["", "a b", "c d e"]
    want = brute(texts, 0.9)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    vectors_ = C.same_vector(rows).where("id = rep and size(tf) > 0").select("rep", "tf").dropDuplicates(["rep"]).cache()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for block in (2048, 64, 17):
        got = {(r.a, r.b): round(r.cosine, 9) for r in S.pairs_over(vectors_.coalesce(1), 0.9, 256, block, forest=True).coalesce(1).collect()}
        assert got.items() <= want.items()
        assert len(got) < tasks * len(texts) < len(want)
        assert components_of(len(texts), got) == components_of(len(texts), want)
    clusters = C.single_linkage_clusters(rows, 0.9).orderBy("id").collect()
    v = vectors(texts)
    equal = [(j, k) for j, k in itertools.combinations(range(len(texts)), 2) if (v[j] == v[k]).all()]
    assert [r.component for r in clusters] == components_of(len(texts), [*want, *equal])


def test_texts_are_cut_once(spark):
    """Pairs and clusters read each text once, and a null text is alike with texts without tokens."""
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    rng = random.Random(5)
    base = long_texts(rng, 4)
    texts = [edited(rng, base[k % 4], 0.02) for k in range(60)] + [None, "", "...", None, base[0], base[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", F.udf(look, "string")("text"))
    got = {(r.a, r.b) for r in C.similarity_pairs(rows, 0.9).collect()}
    assert seen.value == len(texts)
    want = brute(texts, 0.9)
    assert got == want.keys()
    clusters = {r.id: r.component for r in C.single_linkage_clusters(rows, 0.9).collect()}
    assert seen.value == 2 * len(texts)
    bare = list(range(60, 64))
    equal = [(60, k) for k in bare] + [(64, 65)]
    assert [clusters.get(k) for k in range(len(texts))] == components_of(len(texts), [*want, *equal])


def test_bucket_lists(spark):
    """Equal to the column expression, whatever the bytes."""
    texts = ["", "...", "Éa B b3-İi K xK \U0001F600q ſs ß", "A a 1 1 1 zz", "é", "x" * 500 + " y\x00z\tq", *long_texts(random.Random(2), 300, 20, 50)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for buckets in (256, 7):
        got = rows.select(T.bucket_lists(F.col("text"), buckets).alias("a"), T.bucket_counts(F.col("text"), buckets).alias("b")).collect()
        assert len(got) == len(texts) and all(r.a == r.b for r in got)
    assert spark.sql("select cast(null as string) as text").select(T.bucket_lists(F.col("text")).alias("a")).first().a == []


@pytest.mark.parametrize("many", [0.0, 1.0])
def test_many_alike(spark, monkeypatch, many):
    """One product for all pairs, and pairs one by one, in blocks of which some are full and some are not."""
    monkeypatch.setattr(S, "MANY", many)
    rng = random.Random(8)
    base = long_texts(rng, 2)
    texts = [edited(rng, base[k % 2], rng.choice([0.01, 0.05, 0.4])) for k in range(700)]
    v = vectors(texts)
    u = S.units(v)
    head = np.arange(0, 256, 3)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9 - 1e-12, 1)))}
    for kind in (np.float32, np.float64):
        got = [(i, j, c) for x in S.close_pairs(v.astype(kind), v.astype(kind), 0.9, True, head, [0]) for i, j, c in zip(*x)]
        assert len(got) == len(want) and {(i, j) for i, j, _ in got} == want
        assert all(abs(c - u[i] @ u[j]) < 1e-9 for i, j, c in got)


def test_joined_rows_are_not_multiplied(spark):
    """Rows that are one tree with all of the other block are left out before any product."""
    v = vectors([edited(random.Random(k), "a b c d e f g h i j", 0.01) + f" n{k % 3}" for k in range(40)])
    v = np.unique(v, axis=0)
    trees, head, counted = S.Trees(), np.arange(96), [0]
    rows = trees.rows("p", len(v)), trees.rows("p", len(v))
    first = sum(len(i) for i, _, _ in S.close_pairs(v, v, 0.5, True, head, counted, trees, rows))
    assert first == len(v) - 1
    a, b = S.Rows(v, head), S.Rows(v, head)
    a.bound = b.bound = None  # a product would fail
    assert not list(S.close_pairs(a, b, 0.5, True, head, counted, trees, rows))


def test_gaps_around_other_pivots_leave_out_blocks(spark):
    """Blocks of two cells whose angles to a third pivot differ by more than the threshold's never meet."""
    pivots = S.units(np.array([[10.0, 0, 0], [9.0, 3.0, 0], [0, 0, 1.0]]))
    rows = [("a", 0, 0.0, 0.3, 5, [0.0, 0.1, 0.9], [0.3, 0.4, 1.0]), ("b", 1, 0.0, 0.3, 5, [0.1, 0.0, 1.4], [0.4, 0.3, 1.5]), ("c", 1, 0.0, 0.3, 5, [0.1, 0.0, 1.0], [0.4, 0.3, 1.1])]
    blocks = spark.createDataFrame(rows, "path string, cell int, low double, high double, n long, lows array<double>, highs array<double>")
    near = {(r.a, r.b) for r in S.near_blocks(blocks, None, pivots, 0.29).collect()}
    assert near == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "c")}
