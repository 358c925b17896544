"""Queries over all rows, against plain Python."""

import math
import re

from feedloom import rules as R
from feedloom.plans import registry
from feedloom.plans.views import Views


def language(text):
    words = set(re.findall(r"\b[a-zA-ZÀ-ÿ]+\b", text.lower()))
    score = {k: len(words & set(hints)) for k, hints in R.LANGUAGE_HINTS.items()}
    best = max(score, key=score.get)
    return "und" if len(text.strip()) < 3 or not words or score[best] * 10 < len(words) else best


def test_language_of_every_row(spark, sf_dir):
    texts = {r.feedback_id: r.text for r in Views(spark, sf_dir).fb.collect()}
    got = registry.QUERIES["detect_language_all"](spark, sf_dir).collect()
    assert len(got) == len(texts) and {r.feedback_id: r.language for r in got} == {k: language(t) for k, t in texts.items()}


def bucket(word):
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 4294967295
    return h % 256


def vector(text):
    out = [0] * 256
    for w in re.findall("[a-z0-9]+", text.lower()):
        out[bucket(w)] += 1
    return out


def test_cosine_of_every_part(spark, sf_dir):
    other = vector("Red widget")
    want = {}
    for r in Views(spark, sf_dir).part.collect():
        v = vector(r.p_name)
        want[r.p_partkey] = sum(a * b for a, b in zip(v, other)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in other))
    got = registry.QUERIES["cosine_similarity_all"](spark, sf_dir).collect()
    assert len(got) == len(want) and all(abs(r.cosine - want[r.p_partkey]) < 1e-5 for r in got)


def test_status_of_every_row(spark, sf_dir):
    ids = [r.feedback_id for r in Views(spark, sf_dir).fb.select("feedback_id").collect()]
    got = registry.QUERIES["stream_enrich_status_all"](spark, sf_dir).collect()
    want = {i: "timeout" if i % 4 == 0 else "failed" if i % 3 else "completed" for i in ids}
    assert len(got) == len(ids) and {r.feedback_id: r.enrichment_status for r in got} == want


def test_every_row_has_a_cluster_and_every_customer_a_life(spark, sf_dir):
    fb = Views(spark, sf_dir).fb.select("feedback_id", "customer_id").collect()
    assigned = [r.feedback_id for r in registry.QUERIES["stream_clusters"](spark, sf_dir).collect()]
    assert sorted(assigned) == sorted(r.feedback_id for r in fb)
    life = registry.QUERIES["stream_lifecycle"](spark, sf_dir).collect()
    assert sorted(r.cluster_id for r in life if r.status == "active") == sorted({r.customer_id for r in fb})
    assert len({(r.cluster_id, r.status) for r in life}) == len(life)


def test_position_of_every_row(spark, sf_dir):
    rows = sorted(Views(spark, sf_dir).fb.select("feedback_id", "severity").collect(), key=lambda r: (r.severity is None, -(r.severity or 0), r.feedback_id))
    assert rows[-1].severity is None
    got = registry.QUERIES["sort_nulls_last_all"](spark, sf_dir).orderBy("position").collect()
    assert [(r.position, r.feedback_id) for r in got] == [(k, r.feedback_id) for k, r in enumerate(rows, 1)]
