"""Intake, validation, sinks and constraints over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.operators import dedup, ingest as I, quality
from feedloom.plans.registry import query
from feedloom.plans.text_queries import CLEAN, MASK, language_sql, profanity_sql
from feedloom.sources import tables as S

RAW = """
r as (select event_id as id, case event_id % 5 when 0 then 'email' when 1 then 'survey' when 2 then 'call_transcript' when 3 then 'social_post' else 'fax' end as source_channel,
 case event_id % 7 when 0 then chr(9) || ' ' || props || ' ' || chr(10) when 1 then ' ' || chr(13) || chr(10) when 2 then repeat('x', 10001) when 3 then repeat('x', 10000) else props end as text from events)"""


def raw(v):
    k = F.col("event_id")
    channels = F.array(*map(F.lit, ["email", "survey", "call_transcript", "social_post", "fax"]))
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("\t "), "props", F.lit(" \n")))
        .when(k % 7 == 1, " \r\n")
        .when(k % 7 == 2, F.repeat(F.lit("x"), 10001))
        .when(k % 7 == 3, F.repeat(F.lit("x"), 10000))
        .otherwise(F.col("props"))
    )
    return v.events.select(k.alias("id"), F.get(channels, k % 5).alias("source_channel"), text.alias("text"))


@query("ingest_batch", f"""with {RAW}, t as (select *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as c from r)
select id, md5(c) as cleaned, case when source_channel = 'fax' then 'invalid_channel' when c = '' then 'empty_text' when length(c) > 10000 then 'text_too_long' end as reject_reason from t""")
def _(v):
    return I.ingest_batch(raw(v)).select("id", F.md5("cleaned_text").alias("cleaned"), "reject_reason")


@query("src_feedback", "select role as source_channel, count(*) as n, sum(length(text))::bigint as n_chars from conversations group by 1")
def _(v):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    rows = S.src_feedback(v.spark, f"{v.sf_dir}/conversations.parquet", schema=schema)
    return rows.groupBy(F.col("role").alias("source_channel")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("assign_id", "select event_id, sha256(cast(event_id as varchar) || chr(31) || event_type) as id from events")
def _(v):
    return I.assign_id(v.events, "event_id", "event_type").select("event_id", "id")


@query("batch_size_policy", """select event_type as batch_id, count(*) as n_rows, case when count(*) > 10000 then 'over_processing_limit' when count(*) > 1000 then 'over_ingest_limit' end as violation from events group by 1""")
def _(v):
    return I.batch_size_policy(v.events.withColumnRenamed("event_type", "batch_id"))


def posts(v):
    k = F.col("event_id")
    names = F.array(*map(F.lit, ["Reddit", "X", "facebook", "mastodon"]))
    zero = F.lit("0")
    metrics = F.create_map(F.lit("likes"), F.when(k % 2 == 0, zero).otherwise("7"), F.lit("favorites"), F.col("user_id").cast("string"), F.lit("retweets"), F.lit("bad"), F.lit("shares"), F.lit("3"), F.lit("comments"), F.lit("-4"))
    return v.events.select(
        k.alias("feedback_id"),
        F.get(names, k % 4).alias("platform"),
        F.repeat(F.lit("h"), 400).alias("username_handle"),
        k.alias("post_id"),
        F.when(k % 5 == 0, "hi").when(k % 5 == 1, F.repeat(F.lit("y"), 10500)).otherwise(F.col("props")).alias("message_text"),
        F.when(k % 3 == 0, "en").alias("language_code"),
        metrics.alias("metrics"),
        F.col("ts").alias("created_at"),
    )


@query("ingest_social", """select event_id as feedback_id, case event_id % 4 when 0 then 'reddit' when 1 then 'x' else 'facebook' end as platform, 320::bigint as handle_chars,
 case when event_id % 5 = 1 then 10000 else length(props) end::bigint as text_chars, case when event_id % 3 = 0 then 'en' else 'und' end as language_code from events where event_id % 4 < 3 and event_id % 5 <> 0""")
def _(v):
    return I.ingest_social(posts(v)).select("feedback_id", "platform", F.length("username_handle").cast("long").alias("handle_chars"), F.length("message_text").cast("long").alias("text_chars"), "language_code")


@query("engagement_metrics", "select event_id as feedback_id, cast(case when event_id % 2 = 0 then user_id else 7 end as int) as likes, 0 as replies, 3 as reposts from events")
def _(v):
    return posts(v).select("feedback_id", I.engagement_metrics(F.col("metrics")).alias("m")).select("feedback_id", "m.*")


@query("ingest_widget", f"""with p as (select event_id, payload, json_valid(payload) as ok, case when json_valid(payload) then payload else '{{}}' end as j from wp),
f as (select event_id, ok, json_type(j, '$.consent_to_contact') as consent, json_type(j, '$.message_text') as kind, json_extract_string(j, '$.message_text') as message,
  json_extract_string(j, '$.selected_category') as category, json_extract_string(j, '$.submission_channel') as channel from p),
e as (select *, case when not ok then 1 when consent is null or consent = 'NULL' then 2 when consent <> 'BOOLEAN' then 3 when kind is null or kind <> 'VARCHAR' or trim(message) = '' then 4
  when length(message) > 10000 then 5 when category is not null and category not in {tuple(R.THEMES)} then 6 end as rule from f)
select event_id, case rule when 1 then 'payload' when 2 then 'consent_to_contact' when 3 then 'consent_to_contact' when 4 then 'message_text' when 5 then 'message_text' when 6 then 'selected_category' end as error_field,
 case rule when 1 then 'not valid JSON' when 2 then 'is required' when 3 then 'must be a boolean' when 4 then 'is required' when 5 then 'is too long' when 6 then 'is unknown' end as error_message,
 case when channel in ('website_form', 'chat', 'mobile_app', 'support_portal') then channel else 'website_form' end as submission_channel from e""")
def _(v):
    return I.ingest_widget(v.wp).select("event_id", "error_field", "error_message", "submission_channel")


@query("create_feedback", "select feedback_id, 'direct' as source_type, 'pending' as enrichment_status from fb where text <> ''")
def _(v):
    return I.create_feedback(v.fb).select("feedback_id", "source_type", "enrichment_status")


@query("social_to_feedback", "select event_id as feedback_id, case event_id % 4 when 0 then 'reddit' when 1 then 'x' else 'facebook' end as platform, 'social' as source_type from events where event_id % 4 < 3 and event_id % 5 <> 0")
def _(v):
    return I.social_to_feedback(I.ingest_social(posts(v))).select("feedback_id", "platform", "source_type")


@query("union_sources", """select source_type, count(*) as n from (select 'direct' as source_type from fb where text <> ''
 union all select 'social' from events where event_id % 4 < 3 and event_id % 5 <> 0) group by 1""")
def _(v):
    return I.union_sources(v.fb, posts(v)).groupBy("source_type").agg(F.count("*").alias("n"))


@query("validate_submission", """select submission_id, concat_ws(',', case when core_request = '' then 'core_request' end, case when sentiment = 'angry' then 'sentiment' end,
 case when sentiment = 'negative' and (issue_category is null or issue_category not in ('Billing', 'Other')) then 'issue_category' end,
 case when sentiment = 'negative' and length(detailed_description) < 10 then 'detailed_description' end, case when sentiment = 'positive' and praise_text is null then 'praise_text' end,
 case when sentiment = 'neutral' and trim(comment_text) = '' then 'comment_text' end) as errors from sb""")
def _(v):
    return I.validate_submission(v.sb, ["Billing", "Other"]).select("submission_id", F.array_join("errors", ",").alias("errors"))


@query("validate_contact_form", "select submission_id, concat_ws(',', case when phone = '12' then 'phone' end, case when core_request = '' then 'core_request' end) as errors from sb")
def _(v):
    rows = v.sb.withColumnRenamed("customer_name", "name")
    return I.validate_contact_form(rows).select("submission_id", F.array_join("errors", ",").alias("errors"))


@query("table_constraints", """
with t as (select * from rt), l as (select feedback_id, ticket_id from rl)
select 'links' as table_name, cast(feedback_id as varchar) as key, 'reference' as kind, 'ticket_id' as column_name from l where ticket_id not in (select ticket_id from t)
union all select 'links', cast(feedback_id as varchar), 'reference', 'feedback_id' from l where feedback_id % 12 = 0
union all select 'feedback', cast(feedback_id as varchar), 'blank', 'text' from fb where text = '' and feedback_id % 12 <> 0
union all select 'feedback', cast(feedback_id as varchar), 'enum', 'source_type' from fb where source_type = 'direct' and feedback_id % 12 <> 0
union all select 'tickets', cast(ticket_id as varchar), 'reference', 'linked_cluster_id' from t where linked_cluster_id not in (select cluster_id from cl where status <> 'resolved')""")
def _(v):
    feedback = v.fb.where("feedback_id % 12 <> 0")
    clusters = v.cl.where("status <> 'resolved'")
    return quality.table_constraints({"feedback": feedback, "clusters": clusters, "tickets": v.rt, "links": v.rl})


@query("list_batches", """with b as (select batch_id, min(created_at) as batch_ts from fb group by 1), c as (select batch_id, count(*) as n from fb where batch_id <> 'b3' group by 1)
select batch_id, coalesce(n, 0) as record_count from b left join c using (batch_id) where batch_ts >= timestamp '2024-01-01' and batch_ts < timestamp '2024-01-02'""")
def _(v):
    batches = v.fb.groupBy("batch_id").agg(F.min("created_at").alias("batch_ts"))
    out = S.list_batches(batches, v.fb.where("batch_id <> 'b3'"), F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-02")))
    return out.select("batch_id", "record_count")


@query("emit_json", """select '{"customer_id":' || customer_id || ',"feedback_id":' || feedback_id || ',"ticket_id":' || coalesce(cast(ticket_id as varchar), 'null') || '}' as json from fb""")
def _(v):
    return S.emit_json(v.fb.select("ticket_id", "feedback_id", "customer_id"))


@query("read_json_strict", """with p as (select event_id, json_valid(json) as ok, case when json_valid(json) then json else '{}' end as j from js),
f as (select event_id, ok, json_type(j, '$.feedback_id') as id, json_extract_string(j, '$.sentiment_label') as label, json_type(j, '$.sentiment_score') as kind,
  try_cast(json_extract_string(j, '$.sentiment_score') as double) as score, json_extract_string(j, '$.processed_at') as stamp from p)
select event_id, case when not ok then 'malformed' when id is null or id not in ('VARCHAR', 'BIGINT', 'UBIGINT') then 'feedback_id' when label is null or label not in ('positive', 'neutral', 'negative') then 'sentiment_label'
 when kind is null or kind not in ('BIGINT', 'UBIGINT', 'DOUBLE') or not score between -1 and 1 then 'sentiment_score'
 when stamp is null or not regexp_full_match(stamp, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z') then 'processed_at' end as error from f""")
def _(v):
    return S.read_json_strict(v.js).select("event_id", "error")


@query("build_canonical", """select source_type, count(*) as n, count(platform) as n_platform, count(customer_id) as n_customer from (
 select 'social' as source_type, platform, null as customer_id from fb where source_type = 'social' union all select 'widget', null, customer_id from fb where source_type = 'direct') group by 1""")
def _(v):
    social = v.fb.where("source_type = 'social'").select(
        "feedback_id", F.col("feedback_id").alias("post_id"), F.col("text").alias("message_text"), F.col("created_at").alias("ingested_at"), "platform",
        F.lit("h").alias("username_handle"), F.lit(0).alias("engagement"), F.lit(0.5).alias("recency_score"),
    )
    widget = v.fb.where("source_type = 'direct'").select(
        "feedback_id", F.col("text").alias("message_text"), F.col("created_at").alias("ingested_at"), F.lit("chat").alias("submission_channel"),
        F.lit(True).alias("consent_to_contact"), "customer_id", F.lit("basic").alias("account_type"), F.lit("billing").alias("selected_category"),
    )
    out = I.build_canonical(social, widget)
    return out.groupBy("source_type").agg(F.count("*").alias("n"), F.count("platform").alias("n_platform"), F.count("customer_id").alias("n_customer"))


@query("preprocess", f"""with c as (select feedback_id, {CLEAN.format(t='text')} as cleaned from fb)
select feedback_id, {MASK.format(t='cleaned')} as masked_text, case when cleaned = '' then 'und' else {language_sql('cleaned')} end as language, {profanity_sql('cleaned')} as profanity_detected,
 case when cleaned = '' then 'failed' else 'preprocessed' end as processing_status from c""")
def _(v):
    return I.preprocess(v.fb).select("feedback_id", "masked_text", "language", "profanity_detected", "processing_status")


@query("dedup_24h", """
with recursive k as (select source_type, lower(text) as t, created_at, feedback_id, row_number() over (partition by source_type, lower(text) order by created_at, feedback_id) as r from fb),
f as (select source_type, t, r, feedback_id as id, created_at as a from k where r = 1
 union all select k.source_type, k.t, k.r, case when k.created_at - f.a <= interval 24 hour then f.id else k.feedback_id end, case when k.created_at - f.a <= interval 24 hour then f.a else k.created_at end
 from f join k on k.source_type = f.source_type and k.t = f.t and k.r = f.r + 1)
select source_type, id as feedback_id, count(*) - 1 as duplicate_count from f group by 1, 2""")
def _(v):
    rows = v.fb.select("feedback_id", "source_type", F.col("text").alias("masked_text"), F.col("created_at").alias("ts"))
    return dedup.dedup_24h(rows).select("source_type", "feedback_id", "duplicate_count")
