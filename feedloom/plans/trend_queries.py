"""Trend reports over the feedback views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators import trends as T
from feedloom.plans.dashboard_queries import rounded
from feedloom.plans.registry import query

A, B, C = datetime(2024, 1, 1), datetime(2024, 1, 15), datetime(2024, 1, 30)
W = T.Windows(A, B, B, C)
BASE = "created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-01-15'"
CUR = "created_at >= timestamp '2024-01-15' and created_at < timestamp '2024-01-30'"
BASE2 = "created_at between timestamp '2024-01-01' and timestamp '2024-01-15'"
CUR2 = "created_at between timestamp '2024-01-15' and timestamp '2024-01-30'"
# shares of themes in both half-open windows
FREQUENCY = f"""
t as (select count(*) filter ({BASE}) as base_total, count(*) filter ({CUR}) as cur_total from fb),
f as (select theme, count(*) filter ({BASE}) as base_n, count(*) filter ({CUR}) as cur_n from fb where ({BASE}) or ({CUR}) group by 1),
q as (select theme, base_n, cur_n, base_total, cur_total, case when base_total > 0 then base_n / base_total else 0 end as base_share,
  case when cur_total > 0 then cur_n / cur_total else 0 end as cur_share from f, t)"""


def themed(v):
    return v.fb.withColumn("theme_labels", F.array("theme"))


@query("list_in_window", f"select feedback_id, created_at from fb where {CUR2}")
def _(v):
    return T.list_in_window(v.fb, "created_at", B, C).select("feedback_id", "created_at")


@query(
    "collect_window_records",
    """with b as (select batch_id, min(created_at) as batch_ts from fb group by 1)
select feedback_id, fb.batch_id from fb join b on b.batch_id = fb.batch_id where batch_ts >= timestamp '2024-01-01' and batch_ts < timestamp '2024-01-01 00:20:00'""",
)
def _(v):
    batches = v.fb.groupBy("batch_id").agg(F.min("created_at").alias("batch_ts"))
    return T.collect_window_records(v.fb, batches, A, datetime(2024, 1, 1, 0, 20)).select("feedback_id", "batch_id")


@query(
    "window_aggregate",
    f"""
with m as (select 'baseline' as "window", * from fb where {BASE2} union all select 'current', * from fb where {CUR2})
select "window", 'total' as kind, 'all' as value, count(*) as n, round(coalesce(avg(severity_score), 0), 6) as mean_severity from m group by 1
union all select "window", 'sentiment', coalesce(sentiment, 'unknown'), count(*), null from m group by 1, 3
union all select "window", 'department', coalesce(nullif(department, ''), 'none'), count(*), null from m group by 1, 3
union all select "window", 'theme', theme, count(*), null from m group by 1, 3""",
)
def _(v):
    return rounded(T.window_aggregate(themed(v), "created_at", W), "mean_severity")


@query("theme_frequency", f"with {FREQUENCY} select theme, base_n, cur_n, base_total, cur_total, round(base_share, 6) as base_share, round(cur_share, 6) as cur_share from q")
def _(v):
    return rounded(T.theme_frequency(themed(v), "created_at", W), "base_share", "cur_share")


@query("theme_union", f"with {FREQUENCY} select theme, base_n, cur_n, case when base_n = 0 then 'new' when cur_n = 0 then 'vanished' else 'kept' end as change from q")
def _(v):
    return T.theme_union(T.theme_frequency(themed(v), "created_at", W))


@query(
    "window_outer_join",
    f"""with b as (select department, count(*) as base_n from fb where {BASE} group by 1), c as (select department, count(*) as cur_n from fb where {CUR} group by 1)
select coalesce(b.department, c.department) as department, coalesce(base_n, 0) as base_n, coalesce(cur_n, 0) as cur_n from b full join c on b.department = c.department""",
)
def _(v):
    marked = T.in_windows(v.fb, "created_at", W)
    return marked.groupBy("department").agg(F.count_if(F.col("window") == "baseline").alias("base_n"), F.count_if(F.col("window") == "current").alias("cur_n"))


SPIKES = """s as (select theme, round(base_share, 6) as base_share, round(cur_share, 6) as cur_share,
  round(case when base_share > 0 then (cur_share - base_share) / base_share * 100 end, 6) as pct_increase, base_n = 0 and cur_n > 0 as is_new
  from q where cur_n > 0 and (base_n = 0 or (cur_share - base_share) / base_share * 100 >= 1))"""


@query("theme_spikes", f"with {FREQUENCY}, {SPIKES} select * from s")
def _(v):
    return rounded(T.theme_spikes(T.theme_frequency(themed(v), "created_at", W), 1.0), "base_share", "cur_share", "pct_increase")


@query("theme_spike_order", f"with {FREQUENCY}, {SPIKES} select theme, is_new, row_number() over (order by is_new desc, pct_increase desc nulls last, theme) as position from s")
def _(v):
    from pyspark.sql import Window

    ordered = T.theme_spike_order(T.theme_spikes(T.theme_frequency(themed(v), "created_at", W), 1.0))
    order = Window.orderBy(F.desc("is_new"), F.desc_nulls_last("pct_increase"), "theme")  # as many rows as themes
    return ordered.withColumn("position", F.row_number().over(order).cast("long")).select("theme", "is_new", "position")


PROPORTIONS = f"""
m as (select 'baseline' as "window", * from fb where {BASE} union all select 'current', * from fb where {CUR}),
p as (select "window", count(*) as n, count(*) filter (sentiment = 'negative') / count(*) as negative, count(*) filter (sentiment = 'neutral') / count(*) as neutral,
  count(*) filter (sentiment = 'positive') / count(*) as positive from m where sentiment is not null group by 1),
e as (select "window", count(*) as n, avg(severity_score) as mean from m group by 1)"""


@query("sentiment_proportions", f'with {PROPORTIONS} select "window", n, round(negative, 6) as negative, round(neutral, 6) as neutral, round(positive, 6) as positive from p')
def _(v):
    return rounded(T.sentiment_proportions(v.fb, "created_at", W), "negative", "neutral", "positive")


@query("mean_severity", f'with {PROPORTIONS} select "window", n, round(mean, 6) as mean from e')
def _(v):
    return rounded(T.mean_severity(v.fb, "created_at", W), "mean")


def both(value: str, table: str) -> str:
    return f"""select max(n) filter ("window" = 'baseline') as base_n, max(n) filter ("window" = 'current') as cur_n,
  round(max({value}) filter ("window" = 'baseline'), 6) as base, round(max({value}) filter ("window" = 'current'), 6) as cur,
  round(max({value}) filter ("window" = 'current') - max({value}) filter ("window" = 'baseline'), 6) as change from {table}"""


@query("sentiment_shift", f"with {PROPORTIONS}, x as ({both('negative', 'p')}) select base_n, cur_n, base, cur, round(change * 100, 4) as points from x where base_n >= 10 and cur_n >= 10 and change * 100 >= -100")
def _(v):
    out = T.sentiment_shift(T.sentiment_proportions(v.fb, "created_at", W), -100.0)
    return rounded(out, "base", "cur").withColumn("points", F.round("points", 4))


@query("severity_escalation", f"with {PROPORTIONS}, x as ({both('mean', 'e')}) select base_n, cur_n, base, cur, change as difference from x where base_n >= 10 and cur_n >= 10 and change >= -5")
def _(v):
    return rounded(T.severity_escalation(T.mean_severity(v.fb, "created_at", W), -5.0), "base", "cur", "difference")


@query(
    "trend_report",
    f"""
with {FREQUENCY}, {PROPORTIONS}, n as ({both('negative', 'p')}), x as ({both('mean', 'e')}),
found as (
select 'theme_spike' as kind, theme as name, base_share as baseline, cur_share as current, case when base_share > 0 then (cur_share - base_share) / base_share * 100 end as change
from q where cur_n > 0 and (base_n = 0 or (cur_share - base_share) / base_share * 100 >= 50)
union all select 'sentiment_shift', 'negative', base, cur, change * 100 from n where base_n >= 10 and cur_n >= 10 and change * 100 >= 15
union all select 'severity_escalation', 'severity', base, cur, change from x where base_n >= 10 and cur_n >= 10 and change >= 1)
select kind, name, round(baseline, 6) as baseline, round(current, 6) as current, round(change, 4) as change from found, t where base_total >= 10 and cur_total >= 10
union all select 'note', 'too few records', base_total, cur_total, null from t where base_total < 10 or cur_total < 10""",
)
def _(v):
    out = rounded(T.trend_report(themed(v), "created_at", W), "baseline", "current")
    return out.withColumn("change", F.round("change", 4))


DASH = f"""
m as (select 'baseline' as "window", * from fb where {BASE2} union all select 'current', * from fb where {CUR2}),
tot as (select (count(*) filter ("window" = 'baseline'))::double as b, (count(*) filter ("window" = 'current'))::double as c from m)"""


@query(
    "dashboard_trends",
    f"""
with {DASH},
th as (select theme as name, (count(*) filter ("window" = 'baseline'))::double as baseline, (count(*) filter ("window" = 'current'))::double as current from m group by 1),
se as (select coalesce(sentiment, 'unknown') as name, (count(*) filter ("window" = 'baseline'))::double as baseline, (count(*) filter ("window" = 'current'))::double as current from m group by 1),
av as (select coalesce(avg(severity_score) filter ("window" = 'baseline'), 0) as baseline, coalesce(avg(severity_score) filter ("window" = 'current'), 0) as current from m)
select 'theme' as kind, name, baseline, current from th where current > baseline
union all select 'sentiment', name, round(case when b > 0 then baseline / b else 0 end, 6), round(case when c > 0 then current / c else 0 end, 6) from se, tot
union all select 'severity', 'mean', round(baseline, 6), round(current, 6) from av where current > baseline
union all select 'day', cast(cast(created_at as date) as varchar), (count(*) filter ("window" = 'baseline'))::double, (count(*) filter ("window" = 'current'))::double from m group by 2""",
)
def _(v):
    return rounded(T.dashboard_trends(themed(v), "created_at", W), "baseline", "current")


TOTALS = f"""
with {DASH}, th as (select theme, count(*) filter ("window" = 'baseline') as base_n, count(*) filter ("window" = 'current') as cur_n from m group by 1),
k as (select count(*) filter ("window" = 'baseline') as base_n, count(*) filter ("window" = 'current') as cur_n,
 count(*) filter ("window" = 'baseline' and sentiment = 'negative') as base_neg, count(*) filter ("window" = 'current' and sentiment = 'negative') as cur_neg,
 coalesce(avg(severity_score) filter ("window" = 'baseline'), 0) as base_severity, coalesce(avg(severity_score) filter ("window" = 'current'), 0) as cur_severity from m)"""


def totals(v):
    marked = T.in_windows(v.fb, "created_at", W, closed=True)
    base, cur, neg = F.col("window") == "baseline", F.col("window") == "current", F.col("sentiment") == "negative"
    k = marked.agg(
        F.count_if(base).alias("base_n"), F.count_if(cur).alias("cur_n"), F.count_if(base & neg).alias("base_neg"), F.count_if(cur & neg).alias("cur_neg"),
        F.coalesce(F.avg(F.when(base, F.col("severity_score"))), F.lit(0.0)).alias("base_severity"), F.coalesce(F.avg(F.when(cur, F.col("severity_score"))), F.lit(0.0)).alias("cur_severity"),
    )
    themes = marked.groupBy("theme").agg(F.count_if(base).alias("base_n"), F.count_if(cur).alias("cur_n"))
    return k, themes


@query(
    "trend_kpis",
    f"""{TOTALS} select cast(case when base_n > 0 then floor((cur_n - base_n) / base_n * 100 + 0.5) when cur_n > 0 then 100 else 0 end as bigint) as volume_pct,
floor((cur_severity * 2 - base_severity * 2) * 10 + 0.5) / 10 as severity_delta,
cast(case when base_n > 0 then floor(base_neg / base_n * 100 + 0.5) else 0 end as bigint) as base_negative_pct,
cast(case when cur_n > 0 then floor(cur_neg / cur_n * 100 + 0.5) else 0 end as bigint) as cur_negative_pct from k""",
)
def _(v):
    return T.trend_kpis(totals(v)[0])


@query(
    "trend_headline",
    f"""{TOTALS},
top as (select theme, base_n as b, cur_n as c, cur_n - base_n as jump from th order by jump desc, theme limit 1),
z as (select *, floor(cur_neg / cur_n * 100 - base_neg / base_n * 100 + 0.5) as delta, floor((cur_n - base_n) / base_n * 100 + 0.5) as vol, jump >= 2 and c >= b * 1.5 as jumped from k, top)
select case when jumped then '“' || theme || '” reports jumped ' || cast(cast(case when b > 0 then floor((c - b) / b * 100 + 0.5) else 100 end as bigint) as varchar) || '% (' || b || ' → ' || c || ') vs the previous period.'
 when abs(delta) >= 5 then 'Negative sentiment ' || case when delta > 0 then 'up' else 'down' end || ' ' || cast(abs(delta) as bigint) || ' pts vs the previous period (' || cast(floor(base_neg / base_n * 100 + 0.5) as bigint) || '% → ' || cast(floor(cur_neg / cur_n * 100 + 0.5) as bigint) || '%).'
 when abs(vol) >= 10 then 'Feedback volume ' || case when vol > 0 then 'up' else 'down' end || ' ' || cast(abs(vol) as bigint) || '% vs the previous period (' || base_n || ' → ' || cur_n || ').'
 else 'No major shifts vs the previous period — things look steady.' end as headline,
case when jumped then 'bad' when abs(delta) >= 5 then case when delta > 0 then 'bad' else 'good' end when abs(vol) >= 10 then case when vol > 0 then 'bad' else 'good' end else 'neutral' end as tone from z""",
)
def _(v):
    return T.trend_headline(*totals(v))


DAILY = """
d as (select theme, cast(created_at as date) as day, count(*) as n from fb group by 1, 2),
ends as (select min(day) as a, max(day) as b from d),
spine as (select theme, cast(unnest(range(a, b + interval 1 day, interval 1 day)) as date) as day from (select distinct theme from d), ends),
s as (select spine.theme, spine.day, coalesce(n, 0) as n from spine left join d on d.theme = spine.theme and d.day = spine.day)"""


@query("volume_spike", f"""with {DAILY}, w as (select theme, day, n, avg(n) over o as average, count(*) over o as days, max(day) over (partition by theme) as last_day from s
window o as (partition by theme order by day rows between 7 preceding and 1 preceding))
select theme, n as current, round(average, 6) as average, average > 0 and n > 2 * average as spike from w where day = last_day and days = 7""")
def _(v):
    return rounded(T.volume_spike(T.daily_theme_counts(v.fb, "created_at", "theme")), "average")


@query(
    "cluster_sentiment_trend",
    """
with r as (select cluster_id, sentiment_score, row_number() over (partition by cluster_id order by created_at, feedback_id) as up,
  row_number() over (partition by cluster_id order by created_at desc, feedback_id desc) as down from fb where cluster_id is not null),
g as (select cluster_id, count(*) as n, avg(sentiment_score) filter (down <= 10) - avg(sentiment_score) filter (up <= 10) as difference from r group by 1)
select cluster_id, n, round(difference, 6) as difference, case when n < 20 then 'stable' when round(difference, 9) > 0.1 then 'improving' when round(difference, 9) < -0.1 then 'deteriorating' else 'stable' end as trend, n < 20 as too_few from g""",
)
def _(v):
    rows = v.fb.where("cluster_id is not null").withColumnRenamed("created_at", "processed_at")
    return rounded(T.cluster_sentiment_trend(rows), "difference")


@query(
    "cluster_lifecycle",
    """select cluster_id, case when status = 'active' and timestamp '2024-02-10' - last_seen_at > interval 7 day then 'monitoring'
  when status = 'monitoring' and timestamp '2024-02-10' - last_seen_at > interval 21 day then 'resolved' else status end as status from cl""",
)
def _(v):
    return T.cluster_lifecycle(v.cl, F.lit(datetime(2024, 2, 10))).select("cluster_id", "status")


@query("theme_distribution", "select theme as theme_primary, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from fb group by 1")
def _(v):
    return rounded(T.theme_distribution(v.fb.withColumnRenamed("theme", "theme_primary")), "share")


@query("new_cluster_count", "select count(*) filter (first_seen_at between timestamp '2024-01-01' and timestamp '2024-01-01 06:00:00') as new_clusters from cl")
def _(v):
    return T.new_cluster_count(v.cl, A, datetime(2024, 1, 1, 6))


@query(
    "routing_trends",
    f"""with fb2 as (select * from fb where created_at between timestamp '2024-01-01' and timestamp '2024-01-31'),
{DAILY.replace('from fb', 'from fb2')}, w as (select theme, day, n, avg(n) over o as average, count(*) over o as days, max(day) over (partition by theme) as last_day from s
window o as (partition by theme order by day rows between 7 preceding and 1 preceding))
select 'spike' as kind, theme as name, n as n from w where day = last_day and days = 7 and average > 0 and n > 2 * average
union all select 'theme', theme, count(*) from fb2 group by 2
union all select 'trend_clusters', 'all', count(distinct cluster_id) from fb2
union all select 'lifecycle', case when status = 'active' and timestamp '2024-01-31' - last_seen_at > interval 7 day then 'monitoring'
  when status = 'monitoring' and timestamp '2024-01-31' - last_seen_at > interval 21 day then 'resolved' else status end, count(*) from cl group by 2
union all select 'new_clusters', 'all', count(*) filter (first_seen_at between timestamp '2024-01-01' and timestamp '2024-01-31') from cl""",
)
def _(v):
    rows = v.fb.withColumnRenamed("theme", "theme_primary").withColumnRenamed("created_at", "processed_at")
    parts = T.routing_trends(rows, v.cl, datetime(2024, 1, 31))
    pick = lambda df, kind, name, n: df.select(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    every = F.lit("all")
    return (
        pick(parts["volume_spikes"], "spike", F.col("theme"), F.col("current"))
        .unionByName(pick(parts["theme_distribution"], "theme", F.col("theme_primary"), F.col("n")))
        .unionByName(pick(parts["cluster_trends"].agg(F.count("*").alias("n")), "trend_clusters", every, F.col("n")))
        .unionByName(pick(parts["lifecycle"].groupBy("status").agg(F.count("*").alias("n")), "lifecycle", F.col("status"), F.col("n")))
        .unionByName(pick(parts["new_clusters"], "new_clusters", every, F.col("new_clusters")))
    )
