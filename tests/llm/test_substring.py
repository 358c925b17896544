"""Substring dedup against brute force."""

import random

import numpy as np
import pytest

from feedloom.llm import substring as S


def test_tuned_bands():
    bands, rows = S.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 24
    with pytest.raises(ValueError):
        S.tune_bands(0.1, 0.999, 4)


@pytest.mark.parametrize("seed", range(4))
def test_every_window_has_an_anchor(seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2 ** (3 + 20 * seed % 64), 500).astype(np.uint64)
    for long in (8, 30, 50):
        block, n = S.block_shape(long)
        assert block >= S.SHINGLE and block + n - 2 == long
        at = set(S.anchors(h, n).tolist())
        for k in range(len(h) - n + 1):
            least = h[k : k + n].min()
            near = {i for i in range(k, k + n) if h[i] == least}
            assert near & at or len(near) > 1


def words(rng, n, v=4000):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    clean = [(i, "\n".join(" ".join(words(rng, rng.randrange(5, 120))) for _ in range(4))) for i in range(30)]
    inline = words(rng, 51)
    para = words(rng, 100)
    near = para[:]
    near[50] = "changed"
    short = words(rng, 30)
    rows = list(clean)
    for k in range(5):
        rows.append((100 + k, " ".join(words(rng, 10 + 7 * k) + [w.upper() for w in inline] + words(rng, 40))))
    rows += [(200, " ".join(para)), (201, " ".join(words(rng, 60)) + "\n" + " ".join(near)), (202, " ".join(para) + "\n" + " ".join(words(rng, 9)))]
    rows += [(300 + k, " ".join(words(rng, 30) + short[:25] + words(rng, 30))) for k in range(4)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "the " * 9000), (None, " ".join(para)), (500, "x " + " ".join(para)), (500, "x " + " ".join(para))]
    return clean, inline, para, rows


def test_repeats(spark, case):
    clean, inline, para, rows = case
    docs = spark.createDataFrame([(*r, "e", 5) for r in rows], "doc_id long, text string, spans string, n_words int")
    got = {r.doc_id: r for r in S.repeats(docs).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    for i, _ in clean:
        assert got[i].n_removed == 0 and got[i].component_id == i
    for k in range(300, 304):
        assert got[k].n_removed == 0
    assert [got[100 + k].component_id for k in range(5)] == [100] * 5 and got[100].n_removed == 0
    assert all(got[100 + k].n_removed == 51 for k in range(1, 5))
    assert got[200].n_removed == 0 and got[201].n_removed == 100 and got[202].n_removed == 100
    assert {got[k].component_id for k in (200, 201, 202, 500)} == {200}
    assert got[403].n_removed == 0 and got[403].n_words == 9000
    assert all(got[k].n_words == 0 for k in (400, 401, 402))


def test_cut_texts(spark, case):
    clean, inline, para, rows = case
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _x string")
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in clean:
        assert got[i] == [t]
    whole = " ".join(inline)
    assert [whole in got[100 + k][0].lower() for k in range(5)] == [True] + [False] * 4
    assert sum(" ".join(para) in t for k, ts in got.items() if k for t in ts if t) == 1
    assert got[400] == [None] and got[401] == [""] and got[None] == [" ".join(para)]
    texts = dict(rows)
    kept = got[103][0].split()
    assert len(kept) < len(texts[103].split()) and kept[0] == texts[103].split()[0]


def test_texts_are_cut_once(spark):
    """In one Python step of the plan; a document of which no word is left goes, blanks or not."""
    passage, own = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("w", 60), ("v", 100)))
    rows = [(1, f"a {passage} b"), (2, f" \n{passage}\t"), (3, f"{passage} {own}"), (4, " \t"), (5, None)]
    out = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[cut_spans(") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 3: own, 4: " \t", 5: None}


def test_cut_keeps_the_rest(spark):
    text = " é one\ttwo\n\nthree  four five\n"
    df = spark.createDataFrame([(text, [(1, 3), (5, 6)]), (None, [(0, 1)]), ("a", None)], "t string, s array<struct<first:long,after:long>>")
    assert [r[0] for r in df.select(S.cut_spans("t", "s")).collect()] == [" é three  four ", None, "a"]


def test_bands_meet_similar_paragraphs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        a = words(rng, 120)
        b = a[:]
        for k in range(0, 10, 5):
            b[k * 11] = "zz"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed == (120 if r.doc_id % 2 else 0) for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeats(docs).collect() == [] and S.without_repeats(docs).collect() == []


@pytest.mark.parametrize("compared", [128, 2])
def test_a_band_of_unlike_paragraphs(spark, monkeypatch, compared):
    """Paragraphs that share their smallest shingles with the first of the band and little else."""
    monkeypatch.setattr(S, "COMPARED", compared)
    monkeypatch.setattr(S, "tune_bands", lambda: (1, 1))
    rng = random.Random(8)
    common = words(rng, 9)
    rows = [(0, " ".join(common * 6))]
    for i in range(1, 30, 3):
        own = words(rng, 70)
        for k in range(3):
            rows.append((i + k, " ".join(common * 3 + own[: 60 + k])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.repeats(docs).collect()}

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for i, t in rows:
        like = [j for j, u in rows if j < i and len(sets(t) & sets(u)) >= 0.8 * len(sets(t) | sets(u))]
        if (i - 1) % 3 == 0 or i == 0:
            assert not like
        assert not (got[i].n_removed and not like)
        assert got[i].component_id == min([i, *like])


@pytest.mark.parametrize("compared", [128, 5])
def test_a_hub_that_is_not_the_first(spark, monkeypatch, compared):
    """Edited copies that are like their original, which has a larger id, and unlike each other."""
    monkeypatch.setattr(S, "COMPARED", compared)
    rng = random.Random(5)
    hub = words(rng, 200)
    rows = [(1000, " ".join(hub))]
    for i in range(40):
        own = hub[:]
        for k in range(4):
            own[3 + 50 * k + i] = f"edit{i}-{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = S.materialize(docs.mapInArrow(S._profiler(*S.tune_bands()), S.PROFILE), "profiles")
    links = S._similar_paragraphs(profiles).collect()
    assert {x.a.doc_id for x in links} | {x.b.doc_id for x in links} == {i for i, _ in rows}
    assert all(1000 in (x.a.doc_id, x.b.doc_id) for x in links)
    assert {r.component.doc_id for r in S.connected_components(S._similar_paragraphs(profiles)).collect()} == {0}


def wrapped(w, n):
    return "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))


def test_wrapped_near_copies(spark):
    """Near copies over other line breaks are cut whole, not only where they are equal."""
    rng = random.Random(6)
    rows, cut = [], {}
    for i in range(0, 60, 3):
        para = words(rng, 180)
        near = [f"edit{i}-{k}" if k in (44, 89, 134) else w for k, w in enumerate(para)]
        rows.append((i, [" ".join(para), wrapped(para, 13)][i % 2]))
        rows.append((i + 1, wrapped(near, 11) + "\n \n" + wrapped(words(rng, 60), 20)))
        rows.append((i + 2, " ".join(words(rng, 70)) + "\n" + wrapped(near, 50) + "\n" + " ".join(words(rng, 70))))
        cut |= {i: [], i + 1: [(0, 180)], i + 2: [(70, 250)]}
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in got} == cut


def shared_windows(rows, n=51):
    """For each row the places in windows of n words that a row before it has."""
    seen, out = set(), []
    for _, t in sorted(rows):
        w = t.lower().split()
        own = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        out.append({p for k, x in enumerate(own) if x in seen for p in range(k, k + n)})
        seen |= set(own)
    return out


def shared_components(rows, n=51):
    """The smallest document that is reachable over windows of n words that documents share."""
    first, parent = {}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t in sorted(rows):
        w = t.lower().split()
        for k in range(len(w) - n + 1):
            a, b = find(i), find(first.setdefault(tuple(w[k : k + n]), i))
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def brute_equals(spark, rows, long=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in S.repeats(docs, long, 10**6).collect()}  # passages only
    components = shared_components(rows, long + 1)
    for (k, _), places in zip(sorted(rows), shared_windows(rows, long + 1)):
        assert {p for x in got[k].spans for p in range(x[0], x[1])} == places, k
        assert got[k].component_id == components[k] and got[k].n_removed == len(places), k


def test_passages_against_brute_force(spark):
    """What is cut is every word in a window of 51 words that an earlier document has."""
    rng = random.Random(21)
    rows = []
    passages = [words(rng, n) for n in (20, 32, 40, 50, 50, 51, 52, 60, 80, 150) for _ in range(3)]
    for k, p in enumerate(passages * 2):
        rows.append((k, " ".join(words(rng, rng.randrange(0, 60)) + p + words(rng, rng.randrange(0, 60)))))
    rows += [(100, "la " * 45), (101, "x " + "la " * 40 + "y"), (102, "la " * 90), (103, "z " + "la " * 70)]
    brute_equals(spark, rows)
    assert sum(map(bool, shared_windows(rows))) == 16


@pytest.mark.parametrize("a,b,c", [(80, 40, 80), (15, 33, 15), (30, 30, 30), (51, 1, 51)])
def test_passages_of_two_documents(spark, a, b, c):
    """A B in one document, B C in another, A B C in a third: links to both, and no cut of what no
    single document has."""
    rng = random.Random(a * b)
    rows = []
    for k in range(20):
        x, y, z = (words(rng, n, 10**6) for n in (a, b, c))
        fill = lambda: words(rng, rng.randrange(0, 40), 10**6)
        rows += [(3 * k, fill() + x + y + fill()), (3 * k + 1, fill() + y + z + fill()), (3 * k + 2, fill() + x + y + z + fill())]
    brute_equals(spark, [(i, " ".join(w)) for i, w in rows])


def test_mosaics_against_brute_force(spark):
    """Documents made of parts of a few texts, in any order, with edits."""
    rng = random.Random(77)
    texts, rows = [words(rng, 300) for _ in range(6)], []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            t, at, n = rng.choice(texts), rng.randrange(0, 240), rng.choice([12, 30, 49, 51, 70, 140])
            w += t[at : at + n] + words(rng, rng.choice([0, 0, 3]))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    brute_equals(spark, rows)
    brute_equals(spark, rows, 20)


def test_short_paragraphs_by_parameter(spark):
    rng = random.Random(5)
    para, few = " ".join(words(rng, 50)), " ".join(words(rng, 5))
    rows = [(i, f"\n\n{few}\n\n".join([" ".join(words(rng, 60)), " ".join(words(rng, 60))]) + f"\n\n{para}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = lambda **x: [r.n_removed for r in sorted(S.repeats(docs, **x).collect())]
    assert removed() == [0, 0, 0] and removed(paragraph=49) == [0, 50, 50] and removed(paragraph=4) == removed(paragraph=0) == [0, 55, 55]


def test_inside_one_document_repeats_stay(spark):
    rng = random.Random(2)
    para, line = " ".join(words(rng, 80)), " ".join(words(rng, 9))
    rows = [(1, f"{para}\n\n{line}\n\n{para}"), (2, line), (3, f"{line}\n\n{para}\n\n{para} x")]
    got = {r.doc_id: r.n_removed for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the line and the paragraph stand together in the first, too; the last paragraph is a near copy
    assert got[1] == got[2] == 0 and got[3] == 170


def test_one_id_with_other_texts(spark):
    """Another row's repeat never cuts a text of the same id; columns of the operator's names stay."""
    rng = random.Random(13)
    para, alone = words(rng, 90), words(rng, 200)
    rows = [(1, " ".join(para), "a", 1), (7, " ".join(words(rng, 40) + para), "b", 2), (7, " ".join(alone), "c", 3), (7, " ".join(alone), "c", 3), (9, " ".join(words(rng, 30)), "d", 4), (None, " ".join(para), "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _id int")
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r["_id"]): r.text for r in out.collect()}
    assert got[(7, 3)] == " ".join(alone) and got[(1, 1)] == " ".join(para) and got[(9, 4)] == rows[4][1] and got[(None, 5)] == " ".join(para)
    assert out.count() == 6
    assert got[(7, 2)].split() == rows[1][1].split()[:40]
    assert sorted((r.doc_id, r.n_removed, r.component_id) for r in S.repeats(docs).collect()) == [(1, 0, 1), (7, 0, 7), (7, 90, 1), (9, 0, 9)]


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="integer ids"):
        S.repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert S.repeats(spark.createDataFrame([(1, "b")], "doc_id int, text string")).first().n_words == 1


def test_longer_passages_only(spark):
    rng = random.Random(3)
    a, b = words(rng, 70), words(rng, 120)
    rows = [(1, " ".join(a + b)), (2, " ".join(words(rng, 30) + a + words(rng, 30))), (3, " ".join(words(rng, 30) + b + words(rng, 30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed > 0 for r in sorted(S.repeats(docs, long=100).collect())] == [False, False, True]
    with pytest.raises(ValueError):
        S.repeats(docs, long=4)


def test_a_repeated_word_is_one_context(spark, monkeypatch):
    """A word that documents repeat makes blocks of one context: a row a document, not a row a block."""
    rng = random.Random(23)
    rows = [(k, " ".join(words(rng, 20) + ["osas"] * 1000 + words(rng, 20))) for k in range(4)]
    written = {}
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    got = {r.doc_id: r for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in range(4)] == [0, 1000, 1000, 1000]
    assert {r.component_id for r in got.values()} == {0}
    near = written["contexts"]
    assert near.count() == near.select("doc_id", "context").distinct().count() < 4 * 10


def test_a_repeated_word_is_one_block_and_one_span(spark, monkeypatch):
    """Blocks of a word that documents repeat are asked for once a document, and their spans are one:
    no row a block on the way from the runs to the passages."""
    rng = random.Random(29)
    rows = [(k, " ".join(words(rng, 20) + ["osas"] * 1000 + words(rng, 20) + ["osas"] * 90 + words(rng, 20))) for k in range(4)]
    written = {}
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    brute_equals(spark, rows)
    asked = written["runs"].selectExpr("doc_id", "inline(open)")
    assert asked.count() < 4 * 10 < asked.selectExpr("explode(places)").count()
    assert written["passages"].count() < 4 * 20
