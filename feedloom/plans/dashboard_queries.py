"""Dashboard aggregates over the feedback views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.operators import dashboard as D
from feedloom.plans.registry import query

LAST_DAY = "2024-01-28"


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "counts_by_sentiment_triage",
    """
select 'sentiment' as kind, coalesce(sentiment, 'unknown') as value, count(*) as n from fb group by 2
union all select 'triage_outcome', coalesce(triage_outcome, 'unclassified'), count(*) from fb group by 2
union all select 'total', 'all', count(*) from fb""",
)
def _(v):
    return D.counts_by_sentiment_triage(v.fb)


@query(
    "dashboard_totals",
    "select count(*) as total, count(ticket_id) as linked_tickets, count(*) filter (needs_review) as needs_review, count(*) filter (sentiment = 'positive') as positive from fb",
)
def _(v):
    return D.dashboard_totals(v.fb)


@query("scalar_counts", "select count(*) filter (sentiment = 'positive') as positive, count(*) filter (needs_review) as needs_review, count(*) as total from fb")
def _(v):
    return D.dashboard_totals(v.fb).select("positive", "needs_review", "total")


@query("by_department", "select department, count(*) as n from fb where department <> '' group by 1")
def _(v):
    return D.by_department(v.fb)


@query("by_source", "select case when source_type = 'social' and platform <> '' then platform else 'direct' end as source, count(*) as n from fb group by 1")
def _(v):
    return D.by_source(v.fb)


@query("by_state", "select location_state, count(*) as n, round(avg(severity), 6) as mean_severity from fb where location_state is not null group by 1")
def _(v):
    return rounded(D.by_state(v.fb), "mean_severity")


@query(
    "severity_distribution",
    "select cast(s as int) as severity, count(f.severity) as n from range(1, 11) r(s) left join (select severity from fb) f on f.severity = r.s group by 1",
)
def _(v):
    return D.severity_distribution(v.fb)


@query("average_severity", "select round(avg(severity), 6) as mean_severity from fb where severity between 1 and 10")
def _(v):
    return rounded(D.average_severity(v.fb), "mean_severity")


@query(
    "daily_series",
    f"""
with days as (select cast(d as date) as day from range(date '{LAST_DAY}' - interval 29 day, date '{LAST_DAY}' + interval 1 day, interval 1 day) r(d)),
c as (select cast(created_at as date) as day, count(*) as total, count(*) filter (sentiment = 'negative') as negative,
  count(*) filter (sentiment = 'neutral') as neutral, count(*) filter (sentiment = 'positive') as positive from fb group by 1)
select day, coalesce(total, 0) as total, coalesce(negative, 0) as negative, coalesce(neutral, 0) as neutral, coalesce(positive, 0) as positive
from days left join c using (day)""",
)
def _(v):
    return D.daily_series(v.fb, F.to_date(F.lit(LAST_DAY)))


@query("map_points", "select feedback_id, latitude, longitude, severity, sentiment, department from fb where latitude is not null and longitude is not null")
def _(v):
    return D.map_points(v.fb)


@query(
    "geo_clusters",
    """
with p as (select *, case when location_city <> '' and location_state <> '' then location_city || ', ' || location_state
  else printf('%.1f,%.1f', latitude, longitude) end as key, coalesce(sentiment, 'unknown') as s from fb where latitude is not null),
w as (select key, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude, count(*) as n, round(avg(severity), 6) as mean_severity from p group by 1),
ts as (select key, s as top_sentiment from (select key, s, row_number() over (partition by key order by count(*) desc, s) as r from p group by 1, 2) where r = 1),
td as (select key, department as top_department from (select key, department, row_number() over (partition by key order by count(*) desc, department) as r from p where department <> '' group by 1, 2) where r = 1)
select w.*, top_sentiment, top_department from w left join ts using (key) left join td using (key)""",
)
def _(v):
    out = rounded(D.geo_clusters(v.fb), "latitude", "longitude", "mean_severity")
    return out.drop("sentiment_counts", "department_counts")


@query(
    "choropleth_band",
    """
with c as (select location_state as state_code, count(*) as n from fb where location_state is not null group by 1)
select state_code, case state_code when 'TX' then 'Texas' when 'FL' then 'Florida' when 'OH' then 'Ohio' when 'NC' then 'North Carolina' end as state_name, n,
  cast(case when n::double / max(n) over () > 0.8 then 5 when n::double / max(n) over () > 0.6 then 4 when n::double / max(n) over () > 0.4 then 3
  when n::double / max(n) over () > 0.2 then 2 else 1 end as int) as band from c""",
)
def _(v):
    states = v.spark.createDataFrame(list(R.STATES.items()), "state_code string, state_name string")
    return D.choropleth(v.fb, states).drop("mean_severity")


@query(
    "state_names",
    """select feedback_id, location_state, case location_state when 'TX' then 'Texas' when 'FL' then 'Florida' when 'OH' then 'Ohio'
  when 'NC' then 'North Carolina' end as state_name from fb""",
)
def _(v):
    states = v.spark.createDataFrame(list(R.STATES.items()), "location_state string, state_name string")
    return v.fb.select("feedback_id", "location_state").join(F.broadcast(states), "location_state", "left")  # 51 rows


@query("state_lookup", "select case location_state when 'TX' then 'Texas' when 'FL' then 'Florida' when 'OH' then 'Ohio' else 'North Carolina' end as state_name, count(*) as n from fb where location_state is not null group by 1")
def _(v):
    states = v.spark.createDataFrame(list(R.STATES.items()), "location_state string, state_name string")
    return D.by_state(v.fb).join(F.broadcast(states), "location_state").select("state_name", "n")  # 51 rows


@query(
    "enrichment_analytics",
    """
with d as (select * from fb where enrichment_status = 'completed')
select 'status' as kind, enrichment_status as value, count(*)::double as n from fb group by 2
union all select 'theme', theme, count(*)::double from d group by 2
union all select 'severity', 'mean', round(avg(severity_score), 6) from d
union all select 'language', language_code, count(*)::double from d group by 2""",
)
def _(v):
    parts = D.enrichment_analytics(v.fb.withColumn("theme_labels", F.array("theme")))
    n = F.col("n").cast("double").alias("n")
    return (
        parts["status"].select(F.lit("status").alias("kind"), F.col("enrichment_status").alias("value"), n)
        .unionByName(parts["top_themes"].select(F.lit("theme").alias("kind"), F.col("theme").alias("value"), n))
        .unionByName(parts["severity"].select(F.lit("severity").alias("kind"), F.lit("mean").alias("value"), F.round("mean_severity", 6).alias("n")))
        .unionByName(parts["language"].select(F.lit("language").alias("kind"), F.col("language_code").alias("value"), n))
    )


@query("top_themes_k", "select theme, count(*) as n from fb where enrichment_status = 'completed' group by 1 order by n desc, theme limit 10")
def _(v):
    return D.enrichment_analytics(v.fb.withColumn("theme_labels", F.array("theme")))["top_themes"]


@query(
    "count_by_sentiment_progress",
    "select sentiment, progress_state, cast(grouping(sentiment) * 2 + grouping(progress_state) as bigint) as level, count(*) as n from sb group by rollup (sentiment, progress_state)",
)
def _(v):
    return D.count_by_sentiment_progress(v.sb)


@query("top_categories", "select issue_category, count(*) as n from sb where sentiment = 'negative' and issue_category is not null group by 1 order by n desc, issue_category limit 5")
def _(v):
    return D.top_categories(v.sb)


@query(
    "batch_summary",
    "select batch_id, count(*) as submitted, count(*) filter (enrichment_status = 'completed') as successful, count(*) filter (enrichment_status <> 'completed') as failures from fb group by 1",
)
def _(v):
    done = F.col("enrichment_status") == "completed"
    return D.batch_summary(v.fb.where(done), v.fb.where(~done))


@query(
    "classification_accuracy",
    "select count(*) as evaluated, round(avg(case when toxic = quality then 1.0 else 0.0 end), 6) as accuracy from documents d join labels l on l.doc_id = d.doc_id",
)
def _(v):
    insights = v.labels.select(F.col("doc_id").alias("feedback_id"), F.array(F.col("toxic").cast("string"), F.col("toxic").cast("string")).alias("themes"))
    truth = v.documents.select("doc_id").join(v.labels, "doc_id").select(F.col("doc_id").alias("feedback_id"), F.array(F.col("quality").cast("string")).alias("themes"))
    return rounded(D.classification_accuracy(insights, truth), "accuracy")




@query("ground_truth_join", "select count(*) as labelled from documents d join labels l on l.doc_id = d.doc_id")
def _(v):
    return v.documents.select("doc_id").join(v.labels, "doc_id").agg(F.count("*").alias("labelled"))
