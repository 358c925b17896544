"""Inverted multi-index: the grid against all cells, the links against brute force."""

import numpy as np
import pytest

from feedloom.llm import multiindex as M


@pytest.mark.parametrize("seed", range(5))
def test_multi_sequence_order(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random(7), rng.random(5)
    total = (a[:, None] + b[None, :]).ravel()
    got = M.multi_sequence(a, b, 1.0)
    assert sorted(got.tolist()) == np.flatnonzero(total <= 1.0).tolist()
    assert (np.diff(total[got]) >= 0).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(300, 8))
    centres = M.codebook(y, 9)
    bound, home = M.cell_bounds(x, centres), M.distances(y, centres).argmin(axis=1)
    true = M.distances(x, y)
    assert (bound[:, home] <= true + 1e-9).all()


def brute(rows, cosine=0.98):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    use = [r[0] is not None and r[1] is not None and fine(r[2]) for r in rows]
    link = {k: set() for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if use[i] and use[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                x, y = (np.array(rows[k][2], float) / max(map(abs, rows[k][2])) for k in (i, j))
                if rows[i][2] == rows[j][2] or x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    link[i].add(j), link[j].add(i)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in link:
            for j in link[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for k, c in enumerate(label):
        if rows[k][0] is not None:
            least[c] = min(rows[k][0], least.get(c, rows[k][0]))
    return [(r[0], len(link[k]), least.get(label[k]) if r[0] is not None else None) for k, r in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_links(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(25):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 7)):
            v = (base + rng.normal(size=8) * 0.06).astype(np.float32)
            rows.append((len(rows), int(rng.integers(0, 2)), [float(x) for x in v * rng.integers(1, 4)]))
    one = rows[3][2]
    rows += [(1000 + k, 1, one) for k in range(9)] + [(1000, 1, one)]
    rows += [(2000, None, one), (2001, 1, None), (2002, 1, [0.0] * 8), (2003, 1, [float("nan")] * 8), (2004, 1, [None] + one[1:]), (2005, 1, one[:5]), (None, 1, one), (2006, 1, []), (2007, 1, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, size int")
    got = M.near_vectors(df, codes=4, block=block).collect()
    key = lambda r: str(tuple(r)[:3])
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_no_vectors(spark):
    for rows in ([], [(1, 1, None)], [(1, 1, [1.0, 0.0])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        got = M.near_vectors(df).collect()
        assert [tuple(r) for r in got] == [(1, 0, 1, True)] * len(rows)


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.select("vec_id", "label", "embedding").collect()
    label = np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    got = {r.vec_id: r.n_links for r in M.op6_embedding_near_dedup(spark, sf_dir).collect()}
    want = {r[0]: int(n) - 1 for r, n in zip(rows, near.sum(axis=1))}
    assert sum(got.values()) >= 0.99 * sum(want.values())
    assert all(got[k] <= want[k] for k in want)


def test_lengths_and_magnitudes(spark):
    """Rarer lengths link among themselves, and so do very large and very small vectors."""
    rng = np.random.default_rng(8)
    rows = [(k, 0, rng.normal(size=6).tolist()) for k in range(30)]
    for width in (1, 3, 9):
        base = rng.normal(size=width)
        rows += [(len(rows) + k, 0, (base + rng.normal(size=width) * 0.02).tolist()) for k in range(5)]
    rows += [(100, 0, [1.0, 2.0, 3.0]), (101, 0, [1.0, 2.0, 3.0]), (102, 0, [1e200, 2e200, 3e200]), (103, 0, [1e-200, 2e-200, 3e-200]), (104, 0, [1e300, 0.0, 1e-300]), (105, 0, [5.0, 0.0, 0.0]), (106, 0, [5e-324, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for recall in (M.TARGET, 1):
        got = sorted((tuple(r)[:3] for r in M.near_vectors(df, recall=recall).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_exact_traversal(spark):
    """With recall 1 every link is found, whatever the measured rows say."""
    rng = np.random.default_rng(12)
    cloud = rng.normal(size=8)
    rows = [(k, 0, (cloud + rng.normal(size=8) * 0.01).tolist()) for k in range(150)]
    for _ in range(20):
        base = rng.normal(size=8)
        rows += [(len(rows) + k, 0, (base + rng.normal(size=8) * 0.13).tolist()) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted((tuple(r)[:3] for r in M.near_vectors(df, codes=16, recall=1).collect()), key=str) == sorted(brute(rows), key=str)


def test_many_codes_bound_no_more():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(50, 5)), rng.normal(size=(90, 5))
    y = rng.normal(size=(400, 5))
    home = M.distances(y, centres).argmin(axis=1)
    assert (M.cell_bounds(x, centres)[:, home] <= M.distances(x, y) + 1e-9).all()
