"""Text cleaning and scalar text functions, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import rules as R


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip_space(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: str | Column) -> Column:
    """Tags become spaces, characters are composed, runs of two or more white-space characters
    become one space, ends are stripped.  Composing takes a Python worker; it is sent null in
    place of a text that is ASCII, so only texts beyond move."""
    text = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "<[^>]*>", " ")
    text = F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return strip_space(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def mask_pii(text: Column) -> Column:
    """Social security numbers, then e-mail addresses, then US phone numbers."""
    text = F.regexp_replace(text, R.SSN, "[SSN]")
    text = F.regexp_replace(text, R.EMAIL, "[EMAIL]")
    return F.regexp_replace(text, R.PHONE, "[PHONE]")


def strip_pii_for_sharing(text: Column, name: Column) -> Column:
    """Customer's name (any case, taken literally), e-mail addresses and wide phone numbers."""
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    text = F.when(F.length(name) > 0, F.regexp_replace(text, literal, F.lit("[CUSTOMER]"))).otherwise(text)
    text = F.regexp_replace(text, R.EMAIL, "[EMAIL REMOVED]")
    return F.regexp_replace(text, R.WIDE_PHONE, "[PHONE REMOVED]")


def redact_secrets(text: Column, secrets: list[str]) -> Column:
    """Registered secrets, longest first; blank ones are ignored."""
    for secret in sorted({s for s in secrets if s and s.strip()}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def detect_language(text: Column) -> Column:
    """Best overlap of distinct words with the hint words, relative to the words; the first
    language wins ties; ``und`` for short texts and overlaps below a tenth."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-ZÀ-ÿ]+\b"), F.lit(0)))
    hints = list(R.LANGUAGE_HINTS.items())

    def named(size: Column, score: Column) -> Column:
        best, out = F.array_max(score), F.lit("und")
        for i, (k, _) in reversed(list(enumerate(hints))):
            out = F.when(F.get(score, F.lit(i)) == best, k).otherwise(out)
        return F.when((size == 0) | (best * 10 < size), "und").otherwise(out)

    def of(w: Column) -> Column:
        scores = F.array(*(F.size(F.array_intersect(w, F.array(*map(F.lit, h)))) for _, h in hints))
        return _once(scores, lambda s: named(F.size(w), s))

    return F.when(text.isNull() | (F.length(strip_space(text)) < 3), "und").otherwise(_once(words, of))


def profanity_flag(text: Column, words: list[str] = R.PROFANITY) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(False))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def fnv_bucket(token: Column, buckets: int = 256) -> Column:
    """FNV-1a of an ASCII token, 32 bits, modulo the buckets."""
    codes = F.transform(F.split(token, ""), F.ascii)
    mixed = F.aggregate(
        codes,
        F.lit(2166136261).cast("long"),
        lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")),
    )
    return (mixed % buckets).cast("int")


def bucket_counts(text: Column, buckets: int = 256) -> Column:
    """(bucket, n) of a text's tokens in order of bucket: the buckets are sorted once, and each
    run of equal ones is a count."""
    ids = F.array_sort(F.transform(tokenize(text), lambda t: fnv_bucket(t, buckets)))

    def runs(s: Column) -> Column:
        begins = F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i))
        size = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(s)) - F.get(at, j)
        return _once(F.filter(begins, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("bucket"), size(at, j).alias("n"))))

    return _once(ids, runs)


#: Letters and digits stay, all other bytes of a lower-cased text are spaces.
TOKEN_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Tokens whose buckets a task keeps.
KEPT_TOKENS = 1 << 20


class Buckets(dict):
    """Buckets of the tokens that a task has met: FNV-1a, worked out once for each."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, token: bytes) -> int:
        h = 2166136261
        for b in token:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        if len(self) >= KEPT_TOKENS:
            self.clear()
        self[token] = h % self.buckets
        return h % self.buckets


def bucket_lists(text: Column, buckets: int = 256) -> Column:
    """``bucket_counts`` for many long texts, by a Python worker: a token's bucket is worked out once
    a task, not at each place.  A null text has none."""
    known = Buckets(buckets)

    @F.arrow_udf("array<struct<bucket: int, n: int>>")
    def lists(texts: pa.Array) -> pa.Array:
        sizes, ids, counts = [np.zeros(1, np.int64)], [], []
        for at in range(0, len(texts), 256):
            rows, found = [], []
            for raw in texts.slice(at, 256).cast(pa.large_binary()).to_pylist():
                raw = raw or b""
                low = raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()
                tokens = low.translate(TOKEN_BYTES).split()
                rows.append(len(tokens))
                found.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
            number = np.repeat(np.arange(len(rows)), rows) * buckets + np.concatenate(found)
            places, n = np.unique(number, return_counts=True)
            sizes.append(np.bincount(places // buckets, minlength=len(rows)))
            ids.append((places % buckets).astype(np.int32))
            counts.append(n.astype(np.int32))
        empty = [np.zeros(0, np.int32)]
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(empty + x)) for x in (ids, counts)], ["bucket", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).cumsum().astype(np.int32)), pairs)

    return lists(text)


def hash_embedding(text: Column, buckets: int = 256) -> Column:
    """Token counts by bucket, as a map; texts without tokens give an empty one."""
    return F.map_from_entries(F.transform(bucket_counts(text, buckets), lambda x: F.struct(x.bucket, x.n.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two bucket maps: 1 if both are empty, 0 if one is, at most 1."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0)))

    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))

    both = norm(a) * norm(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(F.least(F.lit(1.0), dot / both))


def cache_key(text: Column, language: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\0"), language), 256)


def normalize_text_key(text: Column) -> Column:
    """Lower case, all dashes alike, white space single."""
    text = F.translate(F.lower(text), "‐‑‒–—―−", "-------")
    return strip_space(F.regexp_replace(text, r"(?U)\s+", " "))


def text_preview(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("…"))).otherwise(text)


def mentioned_names(text: Column, stop_words: list[str] = R.NOT_NAMES) -> Column:
    """Names behind words of praise or a role, in order, each once; the first casing stays.
    Names whose every part is a stop word are left out."""
    stop = F.array(*map(F.lit, stop_words))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(R.PRAISE_CUE), F.lit(1))
    found = F.filter(found, lambda n: F.exists(F.split(F.lower(n), r"\s+"), lambda p: ~F.array_contains(stop, p)))
    return F.aggregate(
        found,
        F.array().cast("array<string>"),
        lambda seen, n: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(n)), seen).otherwise(F.concat(seen, F.array(n))),
    )


def natural_key(text: Column, collation: str | None = None) -> Column:
    """Sorting key: numbers led by how many digits they have, so that they compare by value, however
    long they are.  The rest compares in lower case, or as it is under a collation such as
    ``UNICODE`` (base letters first, then accents, then case) or a locale's."""
    text = text.cast("string")
    parts = F.regexp_extract_all(text if collation else F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))

    def number(p: Column) -> Column:
        digits = F.ltrim(p, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    key = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")
    return F.collate(key, collation) if collation else key
