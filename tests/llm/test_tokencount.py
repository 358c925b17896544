"""Token counts: the shared walk against a table for each word alone."""

import random

import public_tokenizers
import pytest

from feedloom.llm import tokencount as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def alone(model, word):
    path = C.SPACE + word
    best = [(0.0, 0)]
    for end in range(1, len(path) + 1):
        options = [(best[s][0] + model.score[path[s:end]], -(best[s][1] + 1)) for s in range(end) if path[s:end] in model.score]
        if options:
            top = max(options)
            best.append((top[0], -top[1]))
        else:
            n = len(path[end - 1].encode())
            best.append((best[-1][0] + n * model.byte, best[-1][1] + n))
    return best[-1][1]


@pytest.mark.parametrize("seed", range(8))
def test_shared_walk(seed):
    rng = random.Random(seed)
    letters = "abcé日😀"[: rng.randrange(1, 7)]
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    model = C.Unigram(list(dict.fromkeys(rng.choice(["", C.SPACE]) + make(5) for _ in range(rng.randrange(0, 30)))))
    words = {make(12) for _ in range(200)}
    model.learn(set(list(words)[:50]))
    model.learn(words)
    assert model.counts == {w: alone(model, w) for w in words}


def test_real_vocabulary():
    model = C.Unigram.load(PATH)
    words = "The theology of thin thinning things, unbelievable! Straße 日本語 \u0000x 12345".split()
    model.learn(set(words))
    assert model.counts == {w: alone(model, w) for w in words}


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "CACHE", 5)  # bytes
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a  b\na"), (4, "a  b\na"), (None, "x" * 30000), (5, "the " * 20000), (6, "a\x85b c　d")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = C.with_token_counts(docs, PATH).collect()
    model = C.fitted(docs, PATH)
    for r in got:
        words = [w for w in "".join(" " if "\t" <= c <= "\r" else c for c in r.text or "").split(" ") if w]
        assert r.tokens.n_pretokens == len(words)
        if len(words) < 100 and len(r.text or "") < 100:
            assert r.tokens.n_tokens == sum(alone(model, w) for w in words)
    assert got[6].tokens.n_tokens == 20000 * alone(model, "the")
    assert C.with_token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def pieces_alone(model, word):
    """Pieces of the best segmentation, by a search over all of them."""
    path = C.SPACE + word
    best = [(0.0, 0, ())]
    for end in range(1, len(path) + 1):
        options = [(best[s][0] + model.score[path[s:end]], -(best[s][1] + 1), -s) for s in range(end) if path[s:end] in model.score]
        if options:
            score, n, s = max(options)
            best.append((score, -n, (*best[-s][2], path[-s:end])))
        else:
            n = len(path[end - 1].encode())
            best.append((best[-1][0] + n * model.byte, best[-1][1] + n, best[-1][2]))
    return best[-1][2]


def test_scores_are_counted(spark):
    texts = ["the cat  sat", "the cat\tthe hat", "日本 the\vunbelievable", None, "", " \n", "the cat  sat", "😀x " * 3000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    prior, fitted = C.Unigram.load(PATH), C.fitted(docs, PATH)
    uses = dict.fromkeys(prior.pieces, 0)
    for t in texts:
        for w in (t or "").split():
            for p in pieces_alone(prior, w):
                uses[p] += 1
    total = sum(uses.values()) + len(uses)
    assert fitted.score == {p: C.math.log((n + 1) / total) for p, n in uses.items()}
    assert fitted.score["▁the"] > fitted.score["▁hat"]


def test_long_pretokens_are_not_kept():
    model = C.Unigram(["aa", "a", C.SPACE])
    assert model.count(["a" * 1000 + " aa", "aa"]) == [(2, 503), (1, 2)]
    assert set(model.counts) == {"aa"} and model.size == C.ENTRY + 2


def test_other_corpus(spark):
    docs = spark.createDataFrame([(1, "the theology")], "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    (r,) = C.with_token_counts(docs, PATH, corpus=empty).collect()
    even = C.Unigram(C.Unigram.load(PATH).pieces, [0] * len(C.Unigram.load(PATH).pieces))
    assert r.tokens.n_tokens == alone(even, "the") + alone(even, "theology")
