"""Toxicity: held-out accuracy, the likelihood's maximum, odd inputs."""

import random

import numpy as np

from feedloom.llm import toxicity as X


def test_fit_recovers_ordered_model():
    rng = np.random.default_rng(1)
    n, features, true = 4000, 6, np.array([3.0, -2, 1, 0, 0, 2])
    x = rng.random((n, features)) < 0.4
    theta = np.array([0.5, 2.0, 3.5])
    grade = (X.sigmoid((x @ true)[:, None] - theta) > rng.random((n, 1))).sum(axis=1)
    row, col = np.nonzero(x)
    w, t = X.fit_ordinal(row, col, n, features, grade, 3)
    assert np.abs(w - true).max() < 0.5 and np.abs(t - theta).max() < 0.5
    assert (np.diff(t) >= 0).all()


def test_held_out(spark, tmp_path):
    rng = random.Random(2)
    bad = [f"bad{i}" for i in range(8)]
    docs, labels = [], []
    for i in range(1500):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(60)]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(1, 5)):
            words[rng.randrange(60)] = rng.choice(bad).upper()
        docs.append((i, " ".join(words), toxic))
        labels.append((i, toxic if i % 2 else None, 1))
    labels += [(99999, 1, 1), (None, 1, 0), (1, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = X.train(d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = X.with_severity(d, model).collect()
    held = [r for r in got if r.doc_id % 2 == 0]
    assert sum(r.severity.rejected == r.toxic for r in held) >= 0.98 * len(held)
    many = [r.severity.expected_severity for r in held if r.toxic and r.text.count("BAD") >= 3]
    one = [r.severity.expected_severity for r in held if r.toxic and r.text.count("BAD") == 1]
    none = [r.severity.expected_severity for r in held if not r.toxic]
    assert np.mean(many) > np.mean(one) > np.mean(none)
    assert all(0 <= r.severity.expected_severity <= 3 for r in got)


def test_odd_rows(spark):
    model = X.OrdinalModel({b"bad": 4.0}, np.array([1.0, 2.0, 3.0]))
    rows = [(1, None), (2, ""), (None, "BAD, bad"), (3, "x " * 50000 + "bad"), (3, "x " * 50000 + "bad"), (4, "badly")]
    got = X.with_severity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    p = [round(r.severity.toxic_probability, 6) for r in got]
    assert p[0] == p[1] == p[5] == 0.268941 and p[2] == p[3] == p[4] == 0.952574
    assert [r.severity.grade for r in got] == [0, 0, 3, 3, 3, 0]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)], [(1, None)], [(1, 1), (2, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert X.with_severity(docs, X.train(docs, labels)).count() == 2
    assert X.accepted(docs.limit(0), labels).collect() == []


def test_labelled_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = X.op2_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = got.join(labels, "doc_id").selectExpr("avg(cast(rejected = (toxic = 1) as int))").first()[0]
    assert r > 0.97


def test_best_cut():
    margin, toxic = np.array([0.0, 0, 1, 5, 7]), np.array([False, False, False, True, True])
    assert X.best_cut(margin, toxic) == 3.0
    assert X.best_cut(np.zeros(4), np.array([True, False, True, False])) == 0.0


def test_expected_severity_of_an_independent_fit():
    """Plain small steps down the penalised likelihood, written apart, end at the same severities."""
    rng = np.random.default_rng(4)
    n, features = 500, 5
    x = (rng.random((n, features)) < 0.4).astype(float)
    grade = (X.sigmoid((x @ [2.5, -1.5, 1, 0, 2])[:, None] - np.array([0.5, 1.5, 3])) > rng.random((n, 1))).sum(axis=1)
    row, col = np.nonzero(x)
    w, t = X.fit_ordinal(row, col, n, features, grade, 3)

    def loss(v):
        reach = np.column_stack([np.ones(n), 1 / (1 + np.exp(v[features:] - (x @ v[:features])[:, None])), np.zeros(n)])
        return -np.log(reach[np.arange(n), grade] - reach[np.arange(n), grade + 1]).mean() + X.PENALTY * np.abs(v[:features]).sum()

    v = np.r_[np.zeros(features), 0.0, 1.0, 2.0]
    for _ in range(3000):
        slope = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5])
        v = v - 0.8 * slope
    mine = X.sigmoid((x @ w)[:, None] - t).sum(axis=1)
    other = X.sigmoid((x @ v[:features])[:, None] - v[features:]).sum(axis=1)
    assert np.abs(mine - other).max() < 0.05


def test_rare_words_never_get_a_weight():
    """What is left out before the fit has weight 0 in a fit that has it."""
    rng = np.random.default_rng(2)
    n = 40_000
    row, col, y = np.r_[rng.permutation(n)[:9000], 5, 7, 7], np.r_[rng.integers(0, 3, 9000), 3, 4, 3], (rng.random(n) < 0.3).astype(int)
    w, _ = X.fit_ordinal(row, col, n, 5, y, 1)
    assert 2 <= X.PENALTY * n and w[3] == w[4] == 0


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(k, "bad word" if k % 2 else "good word", "s", k) for k in range(20)] + [(None, None, "s", 1)], "doc_id long, text string, _severity string, rejected int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    out = X.accepted(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {*range(0, 20, 2), None}


def test_no_word_outside_pulls_harder(monkeypatch):
    """Begun with few features, the fit ends where one of all of them does."""
    rng = np.random.default_rng(6)
    n, features = 1500, 60
    x = rng.random((n, features)) < 0.2
    true = np.where(np.arange(features) < 8, rng.normal(size=features) * 2, 0)
    grade = (X.sigmoid((x @ true)[:, None] - np.array([0.5, 1.5, 3])) > rng.random((n, 1))).sum(axis=1)
    row, col = np.nonzero(x)
    monkeypatch.setattr(X, "PENALTY", 0.004)
    whole = X.fit_ordinal(row, col, n, features, grade, 3)
    monkeypatch.setattr(X, "FIRST", 4)
    part = X.fit_ordinal(row, col, n, features, grade, 3)
    assert np.abs(whole[0] - part[0]).max() < 0.02 and np.abs(whole[1] - part[1]).max() < 0.02
    assert 8 <= np.count_nonzero(part[0]) < features
