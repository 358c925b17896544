"""License scan: base phrases against plain search, rules on written examples."""

import random
import re

import pytest

from feedloom.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_base_phrases():
    rng = random.Random(4)
    parts = ["MIT", "license", "Apache", "General", "public", "the", "xmit", "licenses", "é", "license-MIT", "\n", "mit"]
    scanner = L.Scanner()
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        got = scanner.scan(text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base(text)
        assert set(got["base_labels"]) <= set(got["labels"]) and 0 <= got["score"] <= 1


EXAMPLES = [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("GNU Lesser General Public License v3", "lgpl"),
    ("terms of the GNU Affero General Public License", "agpl"),
    ("subject to the Mozilla Public License, v. 2.0", "mpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Copyright 2020. All rights reserved.", "proprietary"),
    ("placed into the public domain", "public-domain"),
    ("MPL 2.0", "mpl"),
    ("distributed under the terms of the EPL-2.0", "epl"),
    ("CC-BY-SA 4.0", "cc-by-sa"),
]


@pytest.mark.parametrize("text,label", EXAMPLES)
def test_examples(text, label):
    assert label in L.Scanner().scan(("x y. " + text + " z").encode())["labels"]


def test_containment_and_priority():
    got = L.Scanner().scan(b"a GNU Lesser General Public License b")
    assert [(s["first"], s["after"], s["label"]) for s in got["spans"]] == [(1, 6, "lgpl")]
    assert got["labels"] == ["gpl", "lgpl"]  # the base phrase stays
    assert L.Scanner().scan(b"we permit licenses and a common database under mitigation")["labels"] == []


def test_gates_lose_nothing():
    """Without gates nothing more is found."""
    open_ = L.Scanner()
    open_.rules = [([frozenset()], r, p) for _, r, p in open_.rules]
    gated = L.Scanner()
    texts = [t for t, _ in EXAMPLES] + ["covered by the Expat license", "under the terms of the Microsoft Public License", "provided as X11", "Python Software Foundation license 2",
        "common development and distribution license 1.0", "Massachusetts Institute of Technology License", "dual licensed under the mpl 2.0 and gpl", "released with gplv3", "published under ISC license"]
    for t in texts + [a + " " + b for a, b in zip(texts, texts[1:])]:
        assert gated.scan(t.encode()) == open_.scan(t.encode())
    assert len(L.rules()) > 300


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "mit license"), (3, "mit license"), (None, "x " * 50000 + "Apache License"), (4, "nothing here")]
    got = L.with_licenses(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, labels string")).collect()
    assert [r.licenses.n_base for r in got] == [0, 0, 1, 1, 1, 0]
    assert got[4].licenses.first_word == 50000 and got[0].licenses.first_word is None and got[5].licenses.score == 0
    assert L.with_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in L.op7_license_scans(spark, sf_dir).collect():
        n, places, first, last, labels = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, ",".join(labels))
        assert set(labels) <= set(r.labels.split(","))


@pytest.mark.parametrize("name", ["bsd", "new bsd", "revised bsd", "simplified bsd", "modified bsd", "freebsd", "bsd 3 clause", "bsd two clause", "2 clause bsd", "four clause bsd"])
def test_every_name_of_bsd(name):
    got = L.Scanner().scan(f"It is released under the {name} license here".encode())
    assert got["labels"] == ["bsd"] and got["score"] == 0.95


def test_names_hold_their_gate_words():
    """Each alternative of a family's names, in each frame, passes its rule's gate."""
    scanner = L.Scanner()
    for label, (names, versions) in L.FAMILIES.items():
        for name in re.split(r"\|(?![^(]*\))", names):
            plain = re.sub(r"\(\?:\[0-4\]\|two\|three\|four\)", "3", name)
            texts = [f"spdx license identifier {plain}", f"available under the {plain}", f"license is {plain}", f"{plain} style license", f"dual licensed under the {plain} and other"]
            texts += [f"{plain} {v}" for v in versions.split("|") if v]
            for text in texts:
                assert label in scanner.scan(text.encode())["labels"], text


def sampled(parsed, rng):
    """A random match of a parsed expression."""
    from re import _constants as C

    out = ""
    for op, value in parsed:
        if op is C.LITERAL:
            out += chr(value)
        elif op is C.IN:
            kind, v = rng.choice(value)
            out += chr(v) if kind is C.LITERAL else chr(rng.randint(*v)) if kind is C.RANGE else rng.choice("az09")
        elif op is C.SUBPATTERN:
            out += sampled(value[3], rng)
        elif op is C.BRANCH:
            out += sampled(rng.choice(value[1]), rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            out += "".join(sampled(inner, rng) for _ in range(rng.randint(least, min(most, least + 3))))
    return out


def test_sampled_matches_pass_every_gate():
    """Strings of every rule, each alternative many times over: what the expression takes, the gate lets in."""
    from re import _parser

    rng, scanner = random.Random(9), L.Scanner()
    for any_of, rule, pattern in scanner.rules:
        parsed = _parser.parse(rule.pattern)
        for _ in range(40):
            text = sampled(parsed, rng)
            if pattern.search(text):
                present = set(text.split()) & {w.decode() for w in scanner.words}
                assert any(gate <= present for gate in any_of), (rule, text)
                assert scanner.scan(text.encode())["labels"], text
    assert sum(frozenset() in any_of for any_of, _, _ in scanner.rules) == 0


@pytest.mark.parametrize("text,label", [("this is the freebsd license text", "bsd"), ("The software is provided as is, without warranty of any kind, express or implied.", "mit")])
def test_lost_before(text, label):
    assert L.Scanner().scan(text.encode())["labels"] == [label]


def test_long_repetitive_text():
    import time

    scanner, began = L.Scanner(), time.process_time()
    got = scanner.scan(b"mit license " * 100_000)
    assert time.process_time() - began < 6
    assert got["n_base"] == 100_000 and (got["first_word"], got["last_word"]) == (0, 199_998)
    assert len(got["spans"]) == 199_999  # "license mit" is one, too
    assert got["spans"][-1] == {"first": 199_998, "after": 200_000, "label": "mit"}


def test_containment_against_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a := rng.randrange(20), a + rng.randrange(1, 9)) for _ in range(30)]
        seen, kept = L.Longest([a for a, _ in spans]), []
        for a, b in spans:
            assert (seen.reach(a) >= b) == any(s <= a and b <= e for s, e in kept)
            seen.add(a, b)
            kept.append((a, b))
