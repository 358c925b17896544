"""Comparison of time windows, spikes, trends of clusters and headlines.

All windows are arguments; nothing looks at the clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.sources.shared import write_and_read

LEAST_RECORDS = 10


@dataclass(frozen=True)
class Windows:
    """A baseline and a current window; touching is fine, overlap is not."""

    baseline_start: datetime
    baseline_end: datetime
    current_start: datetime
    current_end: datetime

    def __post_init__(self) -> None:
        for a, b in ((self.baseline_start, self.baseline_end), (self.current_start, self.current_end)):
            if not a < b:
                raise ValueError("a window must start before it ends")
        if max(self.baseline_start, self.current_start) < min(self.baseline_end, self.current_end):
            raise ValueError("the windows overlap")

    @classmethod
    def parse(cls, *times: str) -> Windows:
        try:
            return cls(*(datetime.fromisoformat(t.replace("Z", "+00:00")).replace(tzinfo=None) for t in times))
        except (TypeError, AttributeError) as e:
            raise ValueError(f"not a time: {e}") from e

    def flags(self, ts: Column, closed: bool = False) -> tuple[Column, Column]:
        """(in baseline, in current); the end counts only in ``closed`` windows."""

        def inside(a: datetime, b: datetime) -> Column:
            return (ts >= F.lit(a)) & ((ts <= F.lit(b)) if closed else (ts < F.lit(b)))

        return inside(self.baseline_start, self.baseline_end), inside(self.current_start, self.current_end)


def in_windows(rows: DataFrame, ts: str, w: Windows, closed: bool = False) -> DataFrame:
    """Rows of either window once for each window they are in, as ``window``."""
    base, cur = w.flags(F.col(ts), closed)
    names = F.filter(F.array(F.when(base, "baseline"), F.when(cur, "current")), lambda x: x.isNotNull())
    return rows.where(base | cur).withColumn("window", F.explode(names))


def list_in_window(rows: DataFrame, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Rows of the closed window; the condition reaches the scan."""
    return rows.where(F.col(ts).between(F.lit(start), F.lit(end)))


def collect_window_records(insights: DataFrame, batches: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Insights of batches in the half-open window."""
    within = batches.where((F.col("batch_ts") >= F.lit(start)) & (F.col("batch_ts") < F.lit(end))).select("batch_id")
    return insights.join(within, "batch_id", "left_semi")


def window_aggregate(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """Per closed window: counts by theme, sentiment and department, and mean severity, as rows
    (window, kind, value, n, mean)."""
    marked = in_windows(rows, ts, w, closed=True)
    pairs = F.inline(
        F.concat(
            F.array(
                F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")),
                F.struct(F.lit("sentiment").alias("kind"), F.coalesce("sentiment", F.lit("unknown")).alias("value")),
                F.struct(F.lit("department").alias("kind"), F.coalesce(F.nullif("department", F.lit("")), F.lit("none")).alias("value")),
            ),
            F.transform(F.coalesce("theme_labels", F.array().cast("array<string>")), lambda t: F.struct(F.lit("theme").alias("kind"), t.alias("value"))),
        )
    )
    counts = marked.select("window", "severity_score", pairs).groupBy("window", "kind", "value")
    mean = F.when(F.col("kind") == "total", F.coalesce(F.avg("severity_score"), F.lit(0.0)))
    return counts.agg(F.count("*").alias("n"), mean.alias("mean_severity"))


def theme_frequency(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """Both windows' counts of each theme and shares of records, in one pass; a theme that a
    record has twice counts twice."""
    marked = in_windows(rows, ts, w).select("window", "theme_labels")
    totals = marked.agg(F.count_if(F.col("window") == "baseline").alias("base_total"), F.count_if(F.col("window") == "current").alias("cur_total"))
    each = marked.select("window", F.explode("theme_labels").alias("theme"))
    counts = each.groupBy("theme").agg(F.count_if(F.col("window") == "baseline").alias("base_n"), F.count_if(F.col("window") == "current").alias("cur_n"))
    joined = counts.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumns(
        {
            "base_share": F.when(F.col("base_total") > 0, F.col("base_n") / F.col("base_total")).otherwise(0.0),
            "cur_share": F.when(F.col("cur_total") > 0, F.col("cur_n") / F.col("cur_total")).otherwise(0.0),
        }
    )


def theme_union(frequency: DataFrame) -> DataFrame:
    """Themes of either window as kept, new or vanished."""
    change = F.when(F.col("base_n") == 0, "new").when(F.col("cur_n") == 0, "vanished").otherwise("kept")
    return frequency.select("theme", "base_n", "cur_n", change.alias("change"))


def theme_spikes(frequency: DataFrame, least_pct: float = 50.0) -> DataFrame:
    """Themes that are new or whose share grew enough; new ones first, then by growth."""
    pct = F.when(F.col("base_share") > 0, (F.col("cur_share") - F.col("base_share")) / F.col("base_share") * 100)
    marked = frequency.withColumns({"pct_increase": pct, "is_new": (F.col("base_n") == 0) & (F.col("cur_n") > 0)})
    return marked.where((F.col("cur_n") > 0) & (F.col("is_new") | (F.col("pct_increase") >= least_pct))).select(
        "theme", "base_share", "cur_share", "pct_increase", "is_new"
    )


def theme_spike_order(spikes: DataFrame) -> DataFrame:
    return spikes.orderBy(F.desc("is_new"), F.desc_nulls_last("pct_increase"), "theme")


def sentiment_proportions(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """Rated records and shares of the three sentiments per window."""
    marked = in_windows(rows, ts, w).where("sentiment is not null")
    parts = [(F.count_if(F.col("sentiment") == s) / F.count("*")).alias(s) for s in ("negative", "neutral", "positive")]
    return marked.groupBy("window").agg(F.count("*").alias("n"), *parts)


def _both(per_window: DataFrame, value: str) -> DataFrame:
    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("window") == name, F.col(c)))

    return per_window.agg(
        of("baseline", "n").alias("base_n"), of("current", "n").alias("cur_n"), of("baseline", value).alias("base"), of("current", value).alias("cur")
    )


def sentiment_shift(proportions: DataFrame, least_points: float = 15.0) -> DataFrame:
    """Growth of the negative share in percentage points, if both windows have ten records."""
    both = _both(proportions, "negative").withColumn("points", (F.col("cur") - F.col("base")) * 100)
    return both.where((F.col("base_n") >= LEAST_RECORDS) & (F.col("cur_n") >= LEAST_RECORDS) & (F.col("points") >= least_points))


def mean_severity(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    marked = in_windows(rows, ts, w).where("severity_score is not null")
    return marked.groupBy("window").agg(F.count("*").alias("n"), F.avg("severity_score").alias("mean"))


def severity_escalation(means: DataFrame, least: float = 1.0) -> DataFrame:
    both = _both(means, "mean").withColumn("difference", F.col("cur") - F.col("base"))
    return both.where((F.col("base_n") >= LEAST_RECORDS) & (F.col("cur_n") >= LEAST_RECORDS) & (F.col("difference") >= least))


def trend_counts(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """(window, kind, value, n, total): records, themes, sentiments and severities of both windows
    in one pass; ``total`` sums the severities."""
    pairs = F.concat(
        F.array(
            F.struct(F.lit("record").alias("kind"), F.lit("all").alias("value")),
            F.struct(F.when(F.col("sentiment").isNotNull(), "sentiment").alias("kind"), F.col("sentiment").alias("value")),
            F.struct(F.when(F.col("severity_score").isNotNull(), "severity").alias("kind"), F.lit("all").alias("value")),
        ),
        F.transform(F.coalesce("theme_labels", F.array().cast("array<string>")), lambda t: F.struct(F.lit("theme").alias("kind"), t.alias("value"))),
    )
    each = in_windows(rows, ts, w).select("window", "severity_score", F.inline(F.filter(pairs, lambda p: p.kind.isNotNull())))
    return each.groupBy("window", "kind", "value").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "severity", F.col("severity_score"))).alias("total"))


def trend_report(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """Spikes, shift and escalation as rows (kind, name, baseline, current, change); windows of
    fewer than ten records give only a note.  The rows are read once, for ``trend_counts``."""
    counts = write_and_read(trend_counts(rows, ts, w), "trend-counts")
    of = lambda name, c="n": F.coalesce(F.sum(F.when(F.col("window") == name, F.col(c))), F.lit(0))
    totals = counts.where("kind = 'record'").agg(of("baseline").alias("_b"), of("current").alias("_c"))
    share = lambda n, total: F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(0.0)
    themes = counts.where("kind = 'theme'").groupBy(F.col("value").alias("theme")).agg(of("baseline").alias("base_n"), of("current").alias("cur_n"))
    frequency = themes.crossJoin(F.broadcast(totals)).withColumns({"base_share": share("base_n", "_b"), "cur_share": share("cur_n", "_c")})  # one row
    rated = counts.where("kind = 'sentiment'").groupBy("window").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("value") == "negative", F.col("n")).otherwise(0)) / F.sum("n")).alias("negative"))
    means = counts.where("kind = 'severity'").select("window", "n", (F.col("total") / F.col("n")).alias("mean"))
    names = ["kind", "name", "baseline", "current", "change"]
    spikes = theme_spikes(frequency).select(F.lit("theme_spike").alias("kind"), F.col("theme").alias("name"), "base_share", "cur_share", "pct_increase").toDF(*names)
    shift = sentiment_shift(rated).select(F.lit("sentiment_shift"), F.lit("negative"), "base", "cur", "points").toDF(*names)
    harder = severity_escalation(means).select(F.lit("severity_escalation"), F.lit("severity"), "base", "cur", "difference").toDF(*names)
    enough = (F.col("_b") >= LEAST_RECORDS) & (F.col("_c") >= LEAST_RECORDS)
    found = spikes.unionByName(shift).unionByName(harder).crossJoin(F.broadcast(totals)).where(enough).drop("_b", "_c")  # one row
    notes = totals.where(~enough).select(F.lit("note"), F.lit("too few records"), F.col("_b").cast("double"), F.col("_c").cast("double"), F.lit(None).cast("double")).toDF(*names)
    return found.unionByName(notes)


def dashboard_trends(rows: DataFrame, ts: str, w: Windows) -> DataFrame:
    """The dashboard's variant without thresholds: themes that grew, all sentiment deltas, higher
    mean severity, counts per day and window; as rows (kind, name, baseline, current)."""
    agg = window_aggregate(rows, ts, w)

    def value(name: str, c: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("window") == name, c)), F.lit(0.0))

    n = F.col("n").cast("double")
    per = agg.groupBy("kind", "value").agg(value("baseline", n).alias("baseline"), value("current", n).alias("current"))
    themes = per.where("kind = 'theme' and current > baseline").select("kind", F.col("value").alias("name"), "baseline", "current")
    total = per.where("kind = 'total'").select(F.col("baseline").alias("_b"), F.col("current").alias("_c"))
    shares = per.where("kind = 'sentiment'").crossJoin(F.broadcast(total)).select(  # one row
        "kind",
        F.col("value").alias("name"),
        F.when(F.col("_b") > 0, F.col("baseline") / F.col("_b")).otherwise(0.0).alias("baseline"),
        F.when(F.col("_c") > 0, F.col("current") / F.col("_c")).otherwise(0.0).alias("current"),
    )
    mean = agg.where("kind = 'total'").agg(value("baseline", F.col("mean_severity")).alias("baseline"), value("current", F.col("mean_severity")).alias("current"))
    mean = mean.where("current > baseline").select(F.lit("severity").alias("kind"), F.lit("mean").alias("name"), "baseline", "current")
    marked = in_windows(rows, ts, w, closed=True)
    days = marked.groupBy(F.to_date(ts).cast("string").alias("name")).agg(
        F.count_if(F.col("window") == "baseline").cast("double").alias("baseline"), F.count_if(F.col("window") == "current").cast("double").alias("current")
    )
    days = days.select(F.lit("day").alias("kind"), "name", "baseline", "current")
    return themes.unionByName(shares).unionByName(mean).unionByName(days)


def _js_round(x: Column) -> Column:
    """Halves go up, as in the browser."""
    return F.floor(x + 0.5)


def trend_kpis(totals: DataFrame) -> DataFrame:
    """``totals(base_n, cur_n, base_neg, cur_neg, base_severity, cur_severity)`` -> figures of the
    report's head: volume in percent, severity on ten, negative shares in percent."""
    b, c = F.col("base_n"), F.col("cur_n")
    volume = F.when(b > 0, _js_round((c - b) / b * 100)).otherwise(F.when(c > 0, 100).otherwise(0))
    share = lambda neg, n: F.when(n > 0, _js_round(F.col(neg) / n * 100)).otherwise(0)
    delta = _js_round((F.col("cur_severity") * 2 - F.col("base_severity") * 2) * 10) / 10
    return totals.select(
        volume.cast("long").alias("volume_pct"),
        delta.cast("double").alias("severity_delta"),
        share("base_neg", b).cast("long").alias("base_negative_pct"),
        share("cur_neg", c).cast("long").alias("cur_negative_pct"),
    )


def trend_headline(totals: DataFrame, themes: DataFrame) -> DataFrame:
    """(headline, tone): a theme's jump, else the negative share, else the volume, else steady.

    ``themes(theme, base_n, cur_n)`` of growing themes; of equal jumps the first name stands."""
    jump = F.col("cur_n") - F.col("base_n")
    first = F.struct((-jump).alias("j"), F.col("theme").alias("t"))
    one = F.struct(jump.alias("jump"), F.col("base_n").alias("base"), F.col("cur_n").alias("cur"))
    name = themes.agg(F.min_by("theme", first).alias("theme"), F.min_by(one, first).alias("t"))
    b, c = F.col("base_n"), F.col("cur_n")
    base_pct = F.when(b > 0, F.col("base_neg") / b * 100).otherwise(0.0)
    cur_pct = F.when(c > 0, F.col("cur_neg") / c * 100).otherwise(0.0)
    delta = _js_round(cur_pct - base_pct)
    volume = F.when(b > 0, _js_round((c - b) / b * 100)).otherwise(F.when(c > 0, 100).otherwise(0))
    t = F.col("t")
    jumped = (t.jump >= 2) & (t.cur >= t.base * 1.5)
    pct = F.when(t.base > 0, _js_round((t.cur - t.base) / t.base * 100)).otherwise(100)
    whole = lambda x: x.cast("long").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    up = lambda x: F.when(x > 0, "up").otherwise("down")
    text = (
        F.when(jumped, say("“", F.col("theme"), "” reports jumped ", whole(pct), "% (", whole(t.base), " → ", whole(t.cur), ") vs the previous period."))
        .when(F.abs(delta) >= 5, say("Negative sentiment ", up(delta), " ", whole(F.abs(delta)), " pts vs the previous period (", whole(_js_round(base_pct)), "% → ", whole(_js_round(cur_pct)), "%)."))
        .when(F.abs(volume) >= 10, say("Feedback volume ", up(volume), " ", whole(F.abs(volume)), "% vs the previous period (", whole(b), " → ", whole(c), ")."))
        .otherwise("No major shifts vs the previous period — things look steady.")
    )
    tone = (
        F.when(jumped, "bad")
        .when(F.abs(delta) >= 5, F.when(delta > 0, "bad").otherwise("good"))
        .when(F.abs(volume) >= 10, F.when(volume > 0, "bad").otherwise("good"))
        .otherwise("neutral")
    )
    return totals.crossJoin(F.broadcast(name)).select(text.alias("headline"), tone.alias("tone"))  # one row each


def daily_theme_counts(rows: DataFrame, ts: str, theme: str) -> DataFrame:
    """(theme, day, n) for every day from the first to the last of all, zero days too."""
    day = F.to_date(ts)
    counts = rows.where(F.col(theme).isNotNull()).groupBy(F.col(theme).alias("theme"), day.alias("day")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = counts.select("theme").distinct().crossJoin(F.broadcast(ends)).select("theme", F.explode(F.sequence("a", "b")).alias("day"))  # one row
    return spine.join(counts, ["theme", "day"], "left").select("theme", "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def volume_spike(daily: DataFrame, factor: float = 2.0) -> DataFrame:
    """Themes whose last day is over twice the mean of the seven days before it."""
    order = Window.partitionBy("theme").orderBy("day")
    week = order.rowsBetween(-7, -1)
    marked = daily.withColumns(
        {
            "average": F.avg("n").over(week),
            "_days": F.count("*").over(week),
            "_last": F.lead("day").over(order).isNull(),
        }
    )
    return marked.where("_last and _days = 7").select("theme", F.col("n").alias("current"), "average", ((F.col("average") > 0) & (F.col("n") > factor * F.col("average"))).alias("spike"))


def cluster_sentiment_trend(rows: DataFrame, size: int = 10, least: float = 0.1) -> DataFrame:
    """Per cluster the mean score of its last ten records less that of its first ten.

    Every task keeps a cluster's first and last ten of what it reads, so a cluster of any size is
    ten rows a task before the shuffle and is never sorted as a whole.
    """
    by = Window.partitionBy("cluster_id")
    few = rows.select("cluster_id", "processed_at", "feedback_id", "sentiment_score")

    def mean_of(name: str, *order: Column) -> DataFrame:
        # a limit on row numbers is put before the exchange, too
        ends = few.withColumn("_r", F.row_number().over(by.orderBy(*order))).where(F.col("_r") <= size)
        return ends.groupBy(F.col("cluster_id").alias(f"_{name}")).agg(F.avg("sentiment_score").alias(name))

    first = mean_of("first", F.asc("processed_at"), F.asc("feedback_id"))
    last = mean_of("last", F.desc("processed_at"), F.desc("feedback_id"))
    counts = few.groupBy("cluster_id").agg(F.count("*").alias("n"))
    both = counts.join(first, F.col("cluster_id").eqNullSafe(F.col("_first"))).join(last, F.col("cluster_id").eqNullSafe(F.col("_last")))
    got = both.withColumn("difference", F.col("last") - F.col("first"))
    trend = F.when(F.col("n") < 2 * size, "stable").when(F.col("difference") > least, "improving").when(F.col("difference") < -least, "deteriorating").otherwise("stable")
    return got.select("cluster_id", "n", "difference", trend.alias("trend"), (F.col("n") < 2 * size).alias("too_few"))


def cluster_lifecycle(clusters: DataFrame, as_of: Column) -> DataFrame:
    """One step: active and idle for over 7 days -> monitoring; monitoring for over 21 ->
    resolved."""
    idle = F.unix_micros(as_of) - F.unix_micros("last_seen_at")
    day = 86_400_000_000
    after = F.when((F.col("status") == "active") & (idle > 7 * day), "monitoring").when((F.col("status") == "monitoring") & (idle > 21 * day), "resolved")
    return clusters.withColumn("status", F.coalesce(after, "status"))


def theme_distribution(rows: DataFrame) -> DataFrame:
    counts = rows.where("theme_primary is not null").groupBy("theme_primary").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # as many rows as themes


def new_cluster_count(clusters: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return clusters.agg(F.count_if(F.col("first_seen_at").between(F.lit(start), F.lit(end))).alias("new_clusters"))


def routing_trends(analysis: DataFrame, clusters: DataFrame, as_of: datetime, days: int = 30) -> dict[str, DataFrame]:
    """Spikes, distribution, cluster trends, lifecycle and new clusters of the last days."""
    from datetime import timedelta

    if not 1 <= days <= 90:
        raise ValueError("a report covers 1 to 90 days")
    start = as_of - timedelta(days=days)
    recent = list_in_window(analysis, "processed_at", start, as_of)
    return {
        "volume_spikes": volume_spike(daily_theme_counts(recent, "processed_at", "theme_primary")).where("spike"),
        "theme_distribution": theme_distribution(recent),
        "cluster_trends": cluster_sentiment_trend(recent.where("cluster_id is not null")),
        "lifecycle": cluster_lifecycle(clusters, F.lit(as_of)),
        "new_clusters": new_cluster_count(clusters, start, as_of),
    }
