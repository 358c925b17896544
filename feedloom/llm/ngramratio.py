"""Quality rules: counts of a text's surface, and its hashed n-grams' log-likelihood ratio.

All of it is DataFrame functions.  Two multinomials over buckets of hashed 1- and 2-grams are
counted, one of trusted documents and one of all documents; a document's score is its n-grams'
mean gain, in thousandths, floored.  All sums are of integers, so every document's verdict is the
same in whatever order its rows come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import CRC_STEPS_SQL, crc_sql, materialize, table

#: Buckets of the multinomials, so numbers of the array of gains that every task holds.
BUCKETS = 10_000
#: A pair's hash is that of its first token times this plus that of its second.
PAIR = 31
#: One labelled document in ``HELD``, by hash of the id, is kept from the counts and sets the threshold.
HELD = 5
#: A document fails with fewer words, or with a greater share of repeated words (in percent).
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words between blanks; the n-grams' tokens, which are runs of letters, digits and underscores or of symbols.
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\w\x80-\x{10FFFF}]+|[^\w\x09-\x0D\x20\x80-\x{10FFFF}]+"
SYMBOL = "[#*$%&|<>]"
MASK = (1 << 24) - 1


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside windows of three that an array of words holds twice or more.

    The windows are sorted, so equal ones touch; the places of these, sorted, each add the words
    up to the next place, three at most.  They are sorted by 40 bits of hash above 24 bits of
    place.  Where two that touch agree in hash but not in words, and beyond 2^24 words, the words
    themselves are sorted.
    """

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda n, x: n + x)

    def by_words(w: Column) -> Column:
        def same(s: Column, i: Column, j: Column) -> Column:
            a, b = F.get(s, i), F.get(s, j)
            return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))

        rows = F.sort_array(F.transform(firsts(w), lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("at"))))
        again = lambda s: F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["at"]))
        return _with(rows, lambda s: _places(again(s)))

    def firsts(w: Column) -> Column:
        return F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def hashed(w: Column) -> Column:
        return F.sort_array(F.transform(firsts(w), lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long"))))

    def by_hash(w: Column, s: Column) -> Column:
        """Places in pairs of neighbours of one hash; a negative one if their words differ."""

        def place(x: Column, before: Column) -> Column:
            at, other = x.bitwiseAND(MASK).cast("int"), before.bitwiseAND(MASK).cast("int")
            differ = (F.get(w, at) != F.get(w, other)) | (F.get(w, at + 1) != F.get(w, other + 1)) | (F.get(w, at + 2) != F.get(w, other + 2))
            return F.when(differ, F.array(F.lit(-1))).otherwise(F.array(other, at))

        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(F.shiftright(x.bitwiseXOR(y), 24) == 0, place(y, x)))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))

    def fast(w: Column) -> Column:
        found = _with(hashed(w), lambda s: by_hash(w, s))
        return _with(found, lambda p: F.when(F.array_contains(p, -1), by_words(w)).otherwise(F.sort_array(p)))

    return _with(words, lambda w: _with(F.when(F.size(w) <= MASK, fast(w)).otherwise(by_words(w)), covered))


def _places(marked: Column) -> Column:
    return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))


def _hashed_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.crc32(x.cast("binary")))


def _pairs(h: Column, buckets: int) -> Column:
    """Buckets of neighbouring tokens, by the tokens' hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda x, y: ((PAIR * x + y) % buckets).cast("int"))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's tokens and pairs of neighbouring tokens."""
    return _with(_hashed_tokens(text), lambda h: F.concat(F.transform(h, lambda x: (x % buckets).cast("int")), _pairs(h, buckets)))


def base_counts(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Columns of the fixed rules; a null text counts as an empty one.  ``words`` are the text's, if
    they are a column already."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)) if words is None else words
    dup = _with(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOL)) - 1).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)


def labelled(labels: DataFrame) -> DataFrame:
    """(label_id, good, held) of all labelled documents.  Of an id's labels the lowest holds; rows
    without id or label are left out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD)) == 0
    return materialize(known.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 1).alias("good"), held.alias("held")), "labelled")


def gains(docs: DataFrame, fitted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, from the n-grams of all ``docs`` and those of the trusted ones.  Counts
    are combined before the shuffle: a task sends a row a bucket at most, and so many reach the driver.
    The texts are shuffled once to meet the trusted ids, which are too many to broadcast."""
    trusted = fitted.where("good and not held").select("label_id").hint("merge")
    grams = docs.join(trusted, F.col("doc_id") == F.col("label_id"), "left").select(
        F.col("label_id").isNotNull().cast("int").alias("trusted"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket")
    )
    counts = materialize(grams.groupBy("bucket").agg(F.count("*").alias("s"), F.count_if(F.col("trusted") == 1).alias("t")), "buckets")
    total = counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + buckets) / ((F.col("s") + 1.0) * (F.col("all_t") + buckets))
    known = counts.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row
    by_bucket = {r.bucket: r.gain for r in known.collect()}
    return [by_bucket.get(k, 0) for k in range(buckets)]


def mean_gain(text: Column, gain: list[int]) -> Column:
    """Floored mean of a text's n-grams' gains, null without tokens.  The gains stand in the plan
    as one array, so nothing is joined or shuffled."""
    table, none = F.expr(f"cast(split('{','.join(map(str, gain))}', ',') as array<int>)"), F.lit(0).cast("long")

    def mean(h: Column) -> Column:
        alone = F.aggregate(h, none, lambda n, x: n + F.get(table, (x % len(gain)).cast("int")))
        total = F.aggregate(_pairs(h, len(gain)), alone, lambda n, x: n + F.get(table, x))
        return F.when(F.size(h) > 0, F.floor(total / (2 * F.size(h) - 1)))

    return _with(_hashed_tokens(text), mean)


def scored(docs: DataFrame, gain: list[int]) -> DataFrame:
    """Each row of ``docs`` as (doc_id, base counts, score)."""
    text, words = F.coalesce("text", F.lit("")), F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    # words are a column, as an expression that several others name would be worked out by each
    docs = docs.select("doc_id", text.alias("_text")).withColumn("_words", words)
    columns = base_counts(F.col("_text"), F.col("_words")) | {"score": mean_gain(F.col("_text"), gain)}
    return docs.select("doc_id", *(c.alias(n) for n, c in columns.items()))


def threshold(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row: the score from which a document is kept, null (all are kept) without held good or
    held bad documents.

    Where the shares of held good documents above and held bad ones below sum highest; of several
    such gaps between scores the widest, and its middle.  Documents that fail the fixed rules are
    not asked.
    """
    held = fitted.where("held").hint("merge")
    asked = scores.where(~base_failed() & F.col("score").isNotNull()).join(held, F.col("doc_id") == F.col("label_id"))
    by_score = asked.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    # a row a score, of which there are some ten thousand: means of logarithms in thousandths
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gap = by_score.select(
        "score",
        F.lag("score").over(Window.orderBy("score")).alias("prev"),
        (F.sum("b").over(below) * F.sum("g").over(every) - F.sum("g").over(below) * F.sum("b").over(every)).alias("j"),
        (F.sum("g").over(every) * F.sum("b").over(every)).alias("both"),
    ).where("prev is not null and both > 0 and j > 0")
    best = gap.select(F.col("j"), (F.col("score") - F.col("prev")).alias("width"), (-F.col("score")).alias("low"), F.expr("prev + (score - prev + 1) div 2").alias("at"))
    return best.agg(F.max(F.struct("j", "width", "low", "at"))["at"].alias("_least"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept)
    for every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail the fixed rules; repeated rows are judged each; a
    null id has no label; long texts are whole.  Without labels of both kinds all that passes the
    fixed rules is kept; an empty table gives an empty one.
    """
    docs, fitted = docs.select("doc_id", "text"), labelled(labels)
    scores = materialize(scored(docs, gains(docs, fitted)), "scores")
    least = materialize(threshold(scores, fitted), "threshold")
    verdict = ~base_failed() & F.coalesce(F.col("score") >= F.col("_least"), F.lit(True))
    return scores.crossJoin(F.broadcast(least)).withColumns({"base_failed": base_failed(), "kept": verdict}).drop("_least")  # one row


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = rf"""
with {CRC_STEPS_SQL}, texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), d as (
  select r, doc_id, text, regexp_extract_all(text, '{WORD}') as w, regexp_extract_all(text, '{TOKEN}') as t,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines
  from texts
), windows as (
  select r, k, w[k] as a, w[k + 1] as b, w[k + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as k from d)
), again as (
  select r, k from (select r, k, count(*) over (partition by r, a, b, c) as n from windows) where n > 1
), repeats as (
  select r, count(distinct p) as n from (select r, unnest([k, k + 1, k + 2]) as p from again) group by r
), base as (
  select d.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '{SYMBOL}'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from d left join repeats on repeats.r = d.r
), judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from base
), hashed as (
  select g, {crc_sql("g")} as h from (select distinct unnest(t) as g from d), crc_steps
), tokens as (
  select r, k, h from (select r, unnest(t) as g, unnest(range(len(t))) as k from d) join hashed using (g)
), grams as (
  select r, bucket, count(*) as n from (
    select r, h % {BUCKETS} as bucket from tokens
    union all select a.r, ({PAIR} * a.h + b.h) % {BUCKETS} from tokens a join tokens b on a.r = b.r and b.k = a.k + 1) group by all
), labels_of as (
  select doc_id, good, {crc_sql("doc_id::varchar")} % {HELD} = 0 as held
  from (select doc_id, min(quality) = 1 as good from labels where doc_id is not null and quality is not null group by doc_id), crc_steps
), counts as (
  select bucket, sum(n)::double as s, coalesce(sum(n) filter (good and not held), 0)::double as t
  from grams join base on base.r = grams.r left join labels_of on labels_of.doc_id = base.doc_id group by bucket
), gain as (
  select bucket, floor(1000 * ln((t + 1) * (big_s + {BUCKETS}) / ((s + 1) * (big_t + {BUCKETS}))))::bigint as gain
  from counts, (select sum(s) as big_s, sum(t) as big_t from counts)
), score as (
  select r, floor(sum(n * gain)::double / sum(n))::bigint as score from grams join gain using (bucket) group by r
), by_score as (
  select score, count(*) filter (good) as g, count(*) filter (not good) as b
  from judged join score using (r) join labels_of on labels_of.doc_id = judged.doc_id where held and not base_failed group by score
), gaps as (
  select score, lag(score) over (order by score) as prev,
         coalesce(sum(b) over below, 0) * (select sum(g) from by_score) - coalesce(sum(g) over below, 0) * (select sum(b) from by_score) as j
  from by_score window below as (order by score rows between unbounded preceding and 1 preceding)
), least as (
  select max_by(prev + (score - prev + 1) // 2, (j, score - prev, -score)) as least
  from gaps where prev is not null and j > 0 and (select sum(g) * sum(b) from by_score) > 0
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed,
       not base_failed and coalesce(score >= least, true) as kept
from judged left join score using (r), least
"""
