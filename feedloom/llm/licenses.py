"""License scan by ordered signature rules.

A rule is a regular expression over a text's lower-cased words, with a label, a priority and a
confidence.  It is tried only if the text has all keywords of one of its gates.  Gates are worked
out from the expression: each is a set of whole words, and every match holds all words of one of
them, so the prefilter is a lookup of a text's distinct words and loses no match.  Detections that
lie inside a detection of higher priority, or inside a longer one of the same priority, are
suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import WORDS, table, utf8

#: (words, label): places of these phrases are base detections.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: label: (names as patterns over words, patterns of versions or "").
FAMILIES = {
    "mit": (r"mit|expat|mit x11|x11", ""),
    "apache": (r"apache|apache software", r"1 0|1 1|2 0|2"),
    "gpl": (r"gpl|gnu gpl|gplv2|gplv3", r"1 0|2 0|3 0|1|2|3"),
    "lgpl": (r"lgpl|gnu lgpl|lgplv2|lgplv3", r"2 0|2 1|3 0|2|3"),
    "agpl": (r"agpl|gnu agpl|agplv3", r"1 0|3 0|3"),
    "bsd": (r"bsd|new bsd|revised bsd|simplified bsd|modified bsd|freebsd|bsd (?:[0-4]|two|three|four) clause|(?:[0-4]|two|three|four) clause bsd", ""),
    "mpl": (r"mpl", r"1 0|1 1|2 0|2"),
    "epl": (r"epl", r"1 0|2 0|1|2"),
    "cddl": (r"cddl", r"1 0|1 1"),
    "eupl": (r"eupl", r"1 0|1 1|1 2"),
    "isc": (r"isc", ""),
    "zlib": (r"zlib|zlib libpng", ""),
    "boost": (r"boost|boost software|bsl", r"1 0|1"),
    "unlicense": (r"unlicense", ""),
    "wtfpl": (r"wtfpl", r"2 0|2"),
    "artistic": (r"artistic|perl artistic", r"1 0|2 0|2"),
    "python": (r"psf|python software foundation", r"2 0|2"),
    "postgresql": (r"postgresql", ""),
    "openssl": (r"openssl", ""),
    "php": (r"php", r"3 0|3 01"),
    "ofl": (r"ofl|sil ofl|sil open font", r"1 0|1 1"),
    "ncsa": (r"ncsa|university of illinois ncsa", ""),
    "ms-pl": (r"ms pl|microsoft public", ""),
    "ms-rl": (r"ms rl|microsoft reciprocal", ""),
    "odbl": (r"odbl|open database", r"1 0"),
    "gfdl": (r"gfdl|gnu fdl", r"1 1|1 2|1 3"),
}
#: label: full name over words.
FULL_NAMES = {
    "mit": r"massachusetts institute of technology license",
    "apache": r"apache (?:software )?license",
    "gpl": r"gnu general public license",
    "lgpl": r"gnu (?:lesser|library) general public license",
    "agpl": r"gnu affero general public license",
    "gfdl": r"gnu free documentation license",
    "mpl": r"mozilla public license",
    "epl": r"eclipse public license",
    "cddl": r"common development and distribution license",
    "cpl": r"common public license",
    "eupl": r"european union public licen[cs]e",
    "isc": r"internet systems consortium license",
    "boost": r"boost software license",
    "python": r"python software foundation license",
    "ofl": r"sil open font license",
    "odbl": r"open (?:data commons )?open database license",
    "wtfpl": r"do what the fuck you want to public license",
    "cc0": r"cc0",
    "cc-by": r"creative commons attribution(?: [1-4] 0)? (?:international |unported |generic )?licen[cs]e",
    "cc-by-sa": r"creative commons attribution share ?alike",
    "cc-by-nc": r"creative commons attribution non ?commercial",
    "cc-by-nd": r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?",
    "proprietary": r"all rights reserved",
    "public-domain": r"(?:released |dedicated |placed )?(?:in|into|to) the public domain",
}
#: Sentences of licence texts: (label, pattern).
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"neither the name of (?:\w+ ){1,12}?may be used to endorse or promote products"),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", r"you may not use this file except in compliance with the license"),
    ("apache", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("boost", r"distributed under the boost software license"),
    ("wtfpl", r"you just do what the fuck you want to"),
]
#: What stands around a licence's name: (pattern with {n} for the name and {v} for an optional
#: version, priority, confidence).
FRAMES = [
    (r"spdx license identifier {n}(?: {v})?(?: or later| only| clause)?", 5, 1.0),
    (r"(?:licensed|released|distributed|published|available|covered|provided) (?:under|by|with|as) (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?(?: version)?(?: {v})?", 4, 0.95),
    (r"licen[cs]e (?:is )?(?:the )?{n}(?: version)?(?: {v})?", 3, 0.8),
    (r"{n} (?:style |public |software )?licen[cs]e(?: version)?(?: {v})?", 3, 0.9),
    (r"{n}(?: version)? {v}", 2, 0.7),
    (r"dual licensed under (?:the )?{n}(?: {v})? (?:and|or) \w+", 5, 0.95),
]
CC_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, of higher priority first."""
    out = [Rule(label, words, 1, 1.0) for words, label in BASE]
    for label, (names, versions) in FAMILIES.items():
        for name in re.split(r"\|(?![^(]*\))", names):
            for frame, priority, sure in FRAMES:
                if "(?: {v})?" not in frame and "{v}" in frame and not versions:
                    continue
                one = frame.replace("{n}", f"(?:{name})")
                one = one.replace("{v}", f"(?:v ?)?(?:{versions})") if versions else one.replace("(?: {v})?", "")
                out.append(Rule(label, one, priority, sure))
    for label, name in FULL_NAMES.items():
        out.append(Rule(label, rf"{name}(?: (?:version|v))?(?: [1-4](?: [0-9])?)?(?: or (?:any )?later)?", 4, 0.95))
        out.append(Rule(label, rf"(?:under|by) (?:the )?(?:terms of )?(?:the )?{name}", 5, 0.98))
    for label, text in TEXTS:
        out.append(Rule(label, text, 6, 1.0))
    for kind in CC_KINDS:
        label = "cc-" + kind.replace(" ", "-")
        out.append(Rule(label, rf"cc {kind}(?: [1-4] 0)?(?! (?:sa|nc|nd)\b)", 3, 0.9))
        out.append(Rule(label, rf"(?:licensed|released|available) under (?:a )?cc {kind}(?: [1-4] 0)?(?! (?:sa|nc|nd)\b)", 4, 0.95))
    return sorted(dict.fromkeys(out), key=lambda r: (-r.priority, r.label, r.pattern))


@dataclass(frozen=True)
class Shape:
    """What is sure of some of a pattern's matches: the letters before the first space and behind
    the last one (None if they differ), and whole words between.  Without a space there are only
    the letters before."""

    first: str | None
    words: frozenset[str] = frozenset()
    last: str | None = None
    spaced: bool = False

    def then(self, other: Shape) -> Shape:
        def glued(a: str | None, b: str | None) -> str | None:
            return None if a is None or b is None else a + b

        if not self.spaced:
            return Shape(glued(self.first, other.first), other.words, other.last, other.spaced)
        if not other.spaced:
            return Shape(self.first, self.words, glued(self.last, other.first), True)
        middle = glued(self.last, other.first)
        return Shape(self.first, self.words | other.words | {middle} - {None, ""}, other.last, True)

    def either(self, other: Shape) -> Shape:
        """Of two shapes that are alike spaced."""
        same = lambda a, b: a if a == b else None
        return Shape(same(self.first, other.first), self.words & other.words, same(self.last, other.last), self.spaced)

    def keywords(self) -> frozenset[str]:
        return self.words | {w for w in (self.first, self.last) if w}


#: Shapes that are kept apart; beyond, those become one that are alike in less and less.
SHAPES = 24
ALIKE = [lambda s: (s.spaced, s.first, s.last), lambda s: (s.spaced, s.last), lambda s: s.spaced]


def _few(shapes: list[Shape]) -> list[Shape]:
    shapes = list(dict.fromkeys(shapes))
    for alike in ALIKE:
        if len(shapes) <= SHAPES:
            break
        out: dict = {}
        for s in shapes:
            out[alike(s)] = out[alike(s)].either(s) if alike(s) in out else s
        shapes = list(dict.fromkeys(out.values()))
    return shapes


def shapes(parsed) -> list[Shape]:
    """Shapes of a parsed expression: each match has one of them."""
    out = [Shape("")]
    for op, value in parsed:
        if op is C.LITERAL:
            one = [Shape("", frozenset(), "", True) if value == 32 else Shape(chr(value))]
        elif op is C.IN and len(value) <= 4 and all(k is C.LITERAL and c != 32 for k, c in value):
            one = [Shape(chr(c)) for _, c in value]
        elif op is C.IN and all(k in (C.LITERAL, C.RANGE, C.CATEGORY) for k, _ in value):
            one = [Shape(None)]  # a letter or a digit
        elif op is C.SUBPATTERN:
            one = shapes(value[3])
        elif op is C.BRANCH:
            one = _few([s for branch in value[1] for s in shapes(branch)])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            body = shapes(inner)
            # beyond one time only that there may be words more is known
            one = ([Shape("")] if least == 0 else []) + body
            if most != 1:
                one += [Shape(None, frozenset(), None, True)] if any(s.spaced for s in body) else [Shape(None)]
        elif op in (C.ASSERT, C.ASSERT_NOT, C.AT):
            continue  # takes no letters
        else:
            raise ValueError(f"no gate for {op}")
        out = _few([a.then(b) for a in out for b in one])
    return out


def gates(pattern: str) -> list[frozenset[str]]:
    """Keyword sets: a match, which begins and ends with whole words, holds all of one of them."""
    found = {s.keywords() for s in shapes(_parser.parse(pattern))}
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


class Longest:
    """Ends of spans by start: the farthest end among those that start at or before a place."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.best = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.starts, start)
        while at < len(self.best) and self.best[at] < end:
            self.best[at] = end
            at += at & -at

    def reach(self, start: int) -> int:
        at, out = bisect_right(self.starts, start), -1
        while at:
            out = max(out, self.best[at])
            at -= at & -at
        return out


class Scanner:
    """Compiled rules and their gates; made once in a worker."""

    def __init__(self) -> None:
        self.rules = [(gates(r.pattern), r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")) for r in rules()]
        self.words = {k.encode() for any_of, _, _ in self.rules for gate in any_of for k in gate}

    def detections(self, line: str, present: set[str]) -> list[tuple[int, int, Rule]]:
        """Character spans of rules that match, suppressed ones left out."""
        found = []
        for any_of, rule, pattern in self.rules:
            if any(gate <= present for gate in any_of):
                found += [(m.start(), m.end(), rule) for m in pattern.finditer(line)]
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label, d[2].pattern))
        kept, spans = [], Longest([a for a, _, _ in found])
        for a, b, rule in found:
            if spans.reach(a) < b:
                kept.append((a, b, rule))
                spans.add(a, b)
        return sorted(kept, key=lambda d: (d[0], d[1]))

    def scan(self, text: bytes | None) -> dict:
        plain = (text or b"").translate(WORDS)
        split = plain.split()
        out = {"n_words": len(split), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "score": 0.0, "spans": []}
        present = {w.decode() for w in self.words.intersection(split)}
        if not present:
            return out
        line = b" ".join(split).decode("utf-8", "replace")
        blanks = [m.start() for m in re.finditer(" ", line)]
        places, labels = [], set()
        for words, label in BASE:
            # places may overlap, so each is looked for from the letter after the last
            at = line.find(words)
            while at >= 0:
                end = at + len(words)
                if (at == 0 or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
                    places.append(bisect_right(blanks, at))
                    labels.add(label)
                at = line.find(words, at + 1)
        found = self.detections(line, present)
        out["n_base"] = len(places)
        if places:
            out["first_word"], out["last_word"] = min(places), max(places)
        out["base_labels"] = sorted(labels)
        out["labels"] = sorted(labels | {r.label for _, _, r in found})
        out["score"] = max([1.0] * bool(places) + [r.confidence for _, _, r in found], default=0.0)
        out["spans"] = [{"first": bisect_right(blanks, a), "after": bisect_right(blanks, b - 1) + 1, "label": r.label} for a, b, r in found]
        return out


RESULT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
        *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("base_labels", "labels")),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType()), T.StructField("label", T.StringType())]))),
    ]
)
_scanner: list[Scanner] = []


@F.arrow_udf(RESULT)
def scan(text: pa.Array) -> pa.Array:
    if not _scanner:
        _scanner.append(Scanner())
    kind = pa.struct(
        [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]
        + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string())])))]
    )
    return pa.array([_scanner[0].scan(t) for t in utf8(text)], kind)


def with_licenses(docs: DataFrame, name: str = "licenses") -> DataFrame:
    """Adds the struct ``name``: n_words, n_base, first_word, last_word, base_labels, labels,
    score (the surest detection) and spans (word ranges with labels, suppressed ones left out).

    The time is near linear in a text's length, however often it names a licence.  A null text is empty, and an empty one has no detection, null places and score 0.  No row
    moves; repeated rows get equal results.
    """
    return docs.withColumn(name, scan("text"))


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(f"licenses.{c}", ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", *(f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word")), *joined, "licenses.score")
