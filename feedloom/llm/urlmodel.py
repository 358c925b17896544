"""URL filter: the ratio of two character models, one of accepted and one of rejected URLs.

Host rules judge what they fit.  The URLs they judge are the training text of two character
models of variable order: Witten-Bell smoothing mixes each context's counts with the next shorter
context's, down to a uniform alphabet, so a context counts for as much as it has been seen.  A
URL's score is the difference of its log-likelihoods under the two, divided by its length; the
threshold is calibrated on judged URLs that the models have not seen, one in ``HELD_OUT`` by hash.
All counts are taken over all URLs by grouped
sums, and URLs meet the models in a join, so nothing of the model passes through the driver: these
joins are merges, since broadcasts of an order's n-grams, each small as it is shuffled, fill the
driver together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import materialize, table

#: (rule, host suffix, path prefix, verdict)
RULES = [
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
]
#: Characters of the longest n-gram: the longest context and the character behind it.
GRAM = 6
#: Size of the uniform alphabet under all orders, and width of the calibration's score classes.
ALPHABET, STEP = 256, 0.01
#: One judged URL in so many is kept from the models, to calibrate on.
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits as (rule, verdict), or null."""
    out = F.lit(None)
    for name, suffix, prefix, verdict in sorted(rules, key=lambda r: len(r[0])):
        fits = ((F.col(host) == suffix) | F.col(host).endswith("." + suffix)) & F.col(path).startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """A row per character: the n-gram that ends there, cut at the start by blanks.  One look-ahead
    match at each place, so the work and the rows are linear in a URL's length."""
    line = F.concat(F.lit(" " * (GRAM - 1)), "line")
    grams = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return urls.where("length(line) > 0").select("key", "good", "bad", F.explode(grams).alias("gram"))


def _probabilities(counts: DataFrame) -> DataFrame:
    """``counts(gram, good, bad)`` of full n-grams -> (gram, ratio): the log of the two smoothed
    probabilities' quotient, for every n-gram that occurs in any URL."""
    shorter = None
    for size in range(1, GRAM + 1):
        gram = F.substring(F.col("gram"), F.lit(GRAM - size + 1), F.lit(size))
        level = counts.groupBy(gram.alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = F.substring(F.col("gram"), F.lit(1), F.lit(size - 1))
        level = level.withColumn("context", context)
        if size == 1:
            totals = level.agg(*_totals())
            level = level.crossJoin(F.broadcast(totals))  # one row
            below = {m: F.lit(1.0 / ALPHABET) for m in ("good", "bad")}
        else:
            level = level.join(level.groupBy("context").agg(*_totals()).hint("merge"), "context")
            level = level.withColumn("tail", F.substring(F.col("gram"), F.lit(2), F.lit(size - 1)))
            level = level.join(shorter.hint("merge"), "tail")
            below = {m: F.col(f"p_{m}") for m in ("good", "bad")}
        mixed = [((F.col(m) + F.col(f"kinds_{m}") * below[m]) / (F.col(f"all_{m}") + F.col(f"kinds_{m}"))) for m in ("good", "bad")]
        mixed = [F.when(F.col(f"all_{m}") == 0, below[m]).otherwise(x) for m, x in zip(("good", "bad"), mixed)]
        shorter = level.select(F.col("gram").alias("tail"), mixed[0].alias("p_good"), mixed[1].alias("p_bad"))
    return shorter.select(F.col("tail").alias("gram"), (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def _totals() -> list[Column]:
    out = []
    for m in ("good", "bad"):
        out += [F.sum(m).alias(f"all_{m}"), F.count_if(F.col(m) > 0).cast("double").alias(f"kinds_{m}")]
    return out


def scores(urls: DataFrame) -> DataFrame:
    """``urls(key, line, good, bad)`` with 0/1 training marks -> (key, score) of non-empty lines.

    ``key`` is a number or the like that stands for one line; it goes with each n-gram.  N-grams are counted before they are
    shuffled, and a frequent one is a single row of the model, met by a join that splits skew.
    """
    grams = _grams(urls)
    counts = grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    model = _probabilities(materialize(counts, "grams"))
    return grams.select("key", "gram").join(model.hint("merge"), "gram").groupBy("key").agg((F.sum("ratio") / F.count("*")).alias("score"))


def calibrate(judged: DataFrame) -> float:
    """The score from which to allow: where the shares of judged URLs that it gets right, of
    accepted and of rejected ones, sum highest.  ``judged(score, good, n)``.

    Only counts by score class reach the driver: log-ratios of smoothed probabilities are bounded,
    and so are the classes.  With one kind of URL only, everything is that kind.
    """
    at = F.floor(F.col("score") / STEP)
    rows = judged.groupBy(at.alias("at")).agg(F.sum(F.col("n") * F.col("good")).alias("g"), F.sum(F.col("n") * (1 - F.col("good"))).alias("b")).orderBy("at").collect()
    good, bad = sum(r.g for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return float("-inf") if good else float("inf")
    best, cut, below_g, below_b = None, 0.0, 0, 0
    for k, r in enumerate(rows):
        value = (good - below_g) / good + below_b / bad
        middle = (r.at + (rows[k - 1].at + 1 if k else r.at)) / 2 * STEP
        if best is None or value > best:
            best, cut = value, middle
        below_g, below_b = below_g + r.g, below_b + r.b
    return cut


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url, ...)`` -> page_id, host, path, rule, verdict, score.

    A URL without host and text behind it has nothing to score and is blocked unless a rule fits;
    null URLs too.  Rows stay as they are, repeated ones as well; each distinct URL (what follows
    ``://``, its host in lower case) is scored once, so the order of rows changes nothing.  If no
    judged URL of either kind is held out, all judged ones calibrate.
    """
    base = pages.select("page_id", "url")
    parts = base.withColumn("host", host_of("url")).withColumn("path", path_of("url")).withColumn("_rule", rule_of("host", "path", rules))
    behind = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1)
    bare = F.when(F.instr(F.coalesce("url", F.lit("")), "://") == 0, F.coalesce("url", F.lit("")))
    parts = parts.withColumn("line", F.coalesce(bare, F.concat("host", behind)))
    # a line has one host and path, and so one rule
    lines = parts.groupBy("line").agg(F.count("*").alias("n"), F.max("_rule.verdict").alias("verdict"))
    lines = materialize(lines.select(F.monotonically_increasing_id().alias("key"), "line", "n", "verdict"), "urls")
    held = F.pmod(F.xxhash64("line"), F.lit(HELD_OUT)) == 0
    good, bad = (F.coalesce((F.col("verdict") == v) & ~held, F.lit(False)).cast("long") for v in ("allow", "block"))
    scored = materialize(scores(lines.select("key", "line", good.alias("good"), bad.alias("bad"))), "url-scores")
    judged = lines.where("verdict is not null").join(scored.hint("merge"), "key").select("score", "n", (F.col("verdict") == "allow").cast("long").alias("good"), held.alias("held"))
    kinds = judged.agg(F.count_if(F.col("held") & (F.col("good") == 1)), F.count_if(F.col("held") & (F.col("good") == 0))).first()
    cut = calibrate(judged.where("held") if min(kinds) else judged)
    found = parts.join(lines.join(scored.hint("merge"), "key").select("line", "score").hint("merge"), "line", "left")
    model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", model).alias("verdict"), "score")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
