"""Text functions over documents, pages and the feedback views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.functions import display as D
from feedloom.functions import geo, text
from feedloom.operators import ingest as I
from feedloom.operators import responses as Q
from feedloom.plans.registry import query

MASK = "regexp_replace(regexp_replace(regexp_replace({t}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[SSN]', 'g'), '" + R.EMAIL.replace("{", "{{").replace("}", "}}") + "', '[EMAIL]', 'g'), '" + R.PHONE.replace("{", "{{").replace("}", "}}") + "', '[PHONE]', 'g')"
CLEAN = r"trim(regexp_replace(regexp_replace({t}, '<[^>]*>', ' ', 'g'), '\s{{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("clean_text", f"select feedback_id, {CLEAN.format(t='text')} as cleaned from fb")
def _(v):
    return v.fb.select("feedback_id", text.clean_text("text").alias("cleaned"))


SPACE = r"[\t-\r \x{85}\p{Z}]"  # as (?U)\s


@query("clean_pages", f"""select page_id, length(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(html, '<[^>]*>', ' ', 'g')), '{SPACE}{{2,}}', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')) as n_chars from pages""")
def _(v):
    return v.pages.select("page_id", F.length(text.clean_text("html")).cast("long").alias("n_chars"))


@query("empty_after_cleaning", f"select feedback_id, case when {CLEAN.format(t='text')} = '' then 'failed' else 'preprocessed' end as processing_status, case when {CLEAN.format(t='text')} = '' then 'empty_after_cleaning' end as reason from fb")
def _(v):
    return I.preprocess(v.fb).select("feedback_id", "processing_status", "reason")


@query("mask_pii", f"select doc_id, md5({MASK.format(t='text')}) as masked from documents")
def _(v):
    return v.documents.select("doc_id", F.md5(text.mask_pii(F.col("text"))).alias("masked"))


@query("strip_pii_for_sharing", """select submission_id, regexp_replace(regexp_replace(replace(praise_text, customer_name, '[CUSTOMER]'), '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b', '[EMAIL REMOVED]', 'g'), '\\+?\\d[\\d\\s\\-().]{5,14}\\d', '[PHONE REMOVED]', 'g') as shared from sb""")
def _(v):
    return v.sb.select("submission_id", text.strip_pii_for_sharing(F.col("praise_text"), F.col("customer_name")).alias("shared"))


@query("redact_secrets", "select doc_id, md5(replace(replace(text, 'License', '[REDACTED]'), 'the', '[REDACTED]')) as redacted from documents")
def _(v):
    return v.documents.select("doc_id", F.md5(text.redact_secrets(F.col("text"), ["the", "License", "", "  "])).alias("redacted"))


WORD = r"[\p{L}\p{N}\p{M}_]+"  # as (?U)\w+


def language_sql(text: str) -> str:
    """The hint rule: distinct words, the best overlap, the first language of equal ones."""
    words = f"list_distinct(list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda x: regexp_full_match(x, '[a-zA-ZÀ-ÿ]+')))"
    score = {k: f"len(list_intersect({words}, {hints}))" for k, hints in R.LANGUAGE_HINTS.items()}
    best = f"greatest({', '.join(score.values())})"
    whens = " ".join(f"when {s} = {best} then '{k}'" for k, s in score.items())
    return f"case when {text} is null or length(trim({text}, ' ' || chr(9) || chr(10) || chr(13))) < 3 or len({words}) = 0 or {best} * 10 < len({words}) then 'und' {whens} end"


LANGUAGE = f"select feedback_id, {language_sql('text')} as language from fb"


@query("detect_language", LANGUAGE)
def _(v):
    return v.fb.select("feedback_id", text.detect_language(F.col("text")).alias("language"))


@query("detect_language_all", LANGUAGE)
def _(v):
    return v.fb.select("feedback_id", text.detect_language(F.col("text")).alias("language"))


@query("detect_language_documents", f"select lang, {language_sql('text')} as detected, count(*) as n from documents group by 1, 2")
def _(v):
    return v.documents.groupBy("lang", text.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("language_fallback", """select feedback_id, case when language_code = 'fr' or theme_confidence < 0.6 then 'en' else language_code end as language_code, theme_confidence as language_confidence,
  language_code = 'fr' or theme_confidence < 0.6 as uncertain from fb""")
def _(v):
    out = I.language_fallback(F.upper("language_code"), F.col("theme_confidence"), ["en", "es"])
    return v.fb.select("feedback_id", out.alias("l")).select("feedback_id", "l.*")


def profanity_sql(text: str) -> str:
    return f"len(list_intersect(regexp_extract_all(lower({text}), '{WORD}'), {R.PROFANITY})) > 0"


@query("profanity_flag", f"select feedback_id, {profanity_sql('text')} as profanity from fb")
def _(v):
    return v.fb.select("feedback_id", text.profanity_flag(F.col("text")).alias("profanity"))


@query("profanity_turns", f"select conv_id, turn, {profanity_sql('text')} as profanity from conversations")
def _(v):
    return v.conversations.select("conv_id", "turn", text.profanity_flag(F.col("text")).alias("profanity"))


@query("standardize_ts", "select event_id, case when event_id % 3 = 0 then timestamp '2024-03-01' else date_trunc('second', ts) end as ts, event_id % 3 = 0 as stood_in from events")
def _(v):
    given = F.when(F.col("event_id") % 3 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    ts, stood_in = geo.standardize_ts(given, F.to_timestamp(F.lit("2024-03-01")))
    return v.events.select("event_id", ts.alias("ts"), stood_in.alias("stood_in"))


@query("tokenize", "select feedback_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as tokens from fb")
def _(v):
    return v.fb.select("feedback_id", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens"))


@query("token_totals", "select sum(len(regexp_extract_all(lower(text), '[a-z0-9]+')))::bigint as n from documents")
def _(v):
    return v.documents.agg(F.sum(F.size(text.tokenize(F.col("text")))).alias("n"))


FNV = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(tok, ''), lambda c: ascii(c)::ubigint)), lambda h, b: (xor(h, b) * 16777619::ubigint) & 4294967295::ubigint)"


@query("hash_embedding", f"""with t as (select distinct p_name, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as tok from part)
select p_name, tok as token, cast({FNV} % 256 as int) as bucket from t""")
def _(v):
    words = v.part.select("p_name", F.explode(text.tokenize(F.col("p_name"))).alias("token")).distinct()
    return words.withColumn("bucket", text.fnv_bucket(F.col("token")))


COSINE = f"""with n as (select p_name, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as tok from (select distinct p_name from part) union all select '', unnest(['red', 'widget'])),
c as (select p_name, cast({FNV} % 256 as int) as bucket, count(*)::double as k from n group by 1, 2), s as (select p_name, sum(k * k) as q from c group by 1), o as (select * from c where p_name = ''),
d as (select c.p_name, sum(c.k * o.k) as dot from c join o on o.bucket = c.bucket group by 1)
select p_partkey, round(coalesce(dot, 0) / sqrt(q * 2), 6) as cosine from part join s on s.p_name = part.p_name left join d on d.p_name = part.p_name"""


@query("cosine_similarity", COSINE)
def _(v):
    other = text.hash_embedding(F.lit("Red widget"))
    return v.part.select("p_partkey", F.round(text.cosine_similarity(text.hash_embedding(F.col("p_name")), other), 6).alias("cosine"))


@query("cosine_similarity_all", COSINE)
def _(v):
    other = text.hash_embedding(F.lit("Red widget"))
    return v.part.select("p_partkey", F.round(text.cosine_similarity(text.hash_embedding(F.col("p_name")), other), 6).alias("cosine"))


@query("haversine_km", """select feedback_id, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 4) as km from (select feedback_id, pow(sin(radians(30 - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians(30)) * pow(sin(radians(-90 - longitude) / 2), 2) as a from fb where latitude is not null)""")
def _(v):
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(30.0), F.lit(-90.0))
    return v.fb.where("latitude is not null").select("feedback_id", F.round(km, 4).alias("km"))


@query("parse_location", "select feedback_id, case when feedback_id % 3 = 0 then latitude end as latitude, case when feedback_id % 3 = 0 then longitude end as longitude from fb")
def _(v):
    given = (
        F.when(F.col("feedback_id") % 3 == 0, F.concat(F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string")))
        .when(F.col("feedback_id") % 3 == 1, F.concat("location_city", F.lit(", "), "location_state"))
        .otherwise("95.0,10.0")
    )
    return v.fb.select("feedback_id", geo.parse_location(given).alias("p")).select("feedback_id", "p.latitude", "p.longitude")


@query("geotag_location", "select feedback_id, case when location_city is null then null when feedback_id % 3 = 0 then location_city || ', ' || location_state when feedback_id % 3 = 1 then location_city else location_state end as place from fb")
def _(v):
    city = F.when(F.col("feedback_id") % 3 == 2, "  ").otherwise(F.col("location_city"))
    state = F.when(F.col("feedback_id") % 3 == 1, "").otherwise(F.col("location_state"))
    return v.fb.select("feedback_id", geo.geotag_location(city, state).alias("place"))


@query("recency_score", "select event_id, round(case when event_id % 4 = 0 then 0.5 when ts > timestamp '2024-01-25' then 0 else greatest(0, 1 - (epoch_us(timestamp '2024-01-25') - epoch_us(ts)) / 3600000000.0 / 720) end, 6) as score from events")
def _(v):
    created = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    return v.events.select("event_id", F.round(geo.recency_score(created, F.to_timestamp(F.lit("2024-01-25"))), 6).alias("score"))


@query("severity_to_ten", "select p_partkey, cast(least(10, greatest(1, round_even(p_size / 8.0 * 2, 0))) as int) as ten from part")
def _(v):
    return v.part.select("p_partkey", D.severity_to_ten(F.col("p_size") / 8).alias("ten"))


@query("department_for_themes", """select feedback_id, case theme when 'outage' then 'Network Operations' when 'billing' then 'Billing' when 'installation' then 'Field Services' else 'Customer Support' end as department from fb""")
def _(v):
    return v.fb.select("feedback_id", D.department_for_themes(F.array(F.lit("Nothing known"), F.upper("theme"))).alias("department"))


@query("theme_label", "select feedback_id, case feedback_id % 3 when 0 then theme when 1 then intent else department end as label from fb where department <> ''")
def _(v):
    k = F.col("feedback_id") % 3
    label = D.theme_label(F.when(k == 0, F.col("theme")), F.when(k == 1, F.col("intent")).otherwise(""), F.col("department"))
    return v.fb.where("department <> ''").select("feedback_id", label.alias("label"))


@query("issue_category", "select feedback_id, case when feedback_id % 2 = 0 then theme else 'general' end as category from fb")
def _(v):
    labels = F.when(F.col("feedback_id") % 2 == 0, F.array("theme")).otherwise(F.array().cast("array<string>"))
    return v.fb.select("feedback_id", D.issue_category(labels).alias("category"))


@query("normalize_text_key", "select feedback_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as key from fb")
def _(v):
    return v.fb.select("feedback_id", text.normalize_text_key(F.col("text")).alias("key"))


@query("cache_key", "select feedback_id, sha256(text || chr(0) || language_code) as key from fb")
def _(v):
    return v.fb.select("feedback_id", text.cache_key(F.col("text"), F.col("language_code")).alias("key"))


@query("status_message", """select submission_id, case when progress_state = 100 then case when sentiment = 'positive' then 'Praise received & noted!' else 'Your issue has been resolved.' end
 when progress_state = 25 then 'Awaiting Review' when progress_state = 50 then 'Our team is working on this.' when progress_state = 75 then 'Almost there — resolution in progress.' else 'Awaiting Review' end as message from sb""")
def _(v):
    return v.sb.select("submission_id", D.status_message(F.col("progress_state"), F.col("sentiment")).alias("message"))


@query("initial_progress", "select submission_id, case sentiment when 'negative' then 50 when 'positive' then 100 when 'neutral' then 25 end as progress from sb")
def _(v):
    return v.sb.select("submission_id", D.initial_progress(F.col("sentiment")).alias("progress"))


@query("source_display", "select feedback_id, case when source_type = 'social' then 'Social' else 'Direct' end as kind, coalesce(case when source_type = 'social' then platform else channel end, '') as detail from fb")
def _(v):
    kind, detail = D.source_display(F.col("source_type"), F.col("platform"), F.col("channel"))
    return v.fb.select("feedback_id", kind.alias("kind"), detail.alias("detail"))


@query("source_key", "select feedback_id, coalesce(platform, 'direct') as source from fb")
def _(v):
    return v.fb.select("feedback_id", D.source_key(F.col("source_type"), F.col("platform")).alias("source"))


@query("source_label", "select feedback_id, upper(theme[1]) || theme[2:] as label from fb")
def _(v):
    return v.fb.select("feedback_id", D.source_label(F.col("theme")).alias("label"))


@query("severity_band", """select feedback_id, case when severity >= 8 then 'critical' when severity >= 6 then 'high' when severity >= 4 then 'medium' when severity is not null then 'low' end as chip,
case when severity is null then 'neutral' when severity >= 9 then 'critical' when severity >= 7 then 'high' when severity >= 4 then 'medium' else 'low' end as chart from fb""")
def _(v):
    return v.fb.select("feedback_id", D.severity_chip(F.col("severity")).alias("chip"), D.severity_chart(F.col("severity")).alias("chart"))


@query("status_label", """select feedback_id, case when enrichment_status = 'pending' then 'We''re reviewing your feedback' when enrichment_status in ('failed', 'timeout') then 'We''ve received your feedback'
 when ticket_id is not null then 'A ticket has been opened for your feedback' else 'Your feedback has been reviewed' end as label,
 case triage_outcome when 'action_required' then 'Action required — we are handling this as a ticket.' when 'no_action' then 'Reviewed and retained as feedback.' end as triage from fb""")
def _(v):
    return v.fb.select("feedback_id", D.status_label(F.col("enrichment_status"), F.col("ticket_id").isNotNull()).alias("label"), D.triage_label(F.col("triage_outcome")).alias("triage"))


@query("status_steps", """with s as (select feedback_id, triage_outcome, status from fb left join tk on tk.ticket_id = fb.ticket_id)
select feedback_id, case when status is not null then 'Submitted:done,Reviewed:' || case when triage_outcome is null then 'active' else 'done' end || ',Ticket opened:done,In progress:' || case when status = 'open' then 'active' else 'done' end
  || ',Resolved:' || case status when 'resolved' then 'done' when 'in_progress' then 'active' else 'upcoming' end
 when triage_outcome = 'no_action' then 'Submitted:done,Reviewed:done,Logged as feedback:done' else 'Submitted:done,Reviewed:' || case when triage_outcome is null then 'active' else 'done' end end as steps from s""")
def _(v):
    joined = v.fb.join(v.tk.select("ticket_id", "status"), "ticket_id", "left")
    steps = D.status_steps(F.col("triage_outcome"), F.col("status"))
    return joined.select("feedback_id", F.array_join(F.transform(steps, lambda s: F.concat(s.label, F.lit(":"), s.state)), ",").alias("steps"))


@query("text_preview", "select doc_id, md5(case when length(text) > 120 then rtrim(text[1:120]) || '…' else text end) as preview from documents")
def _(v):
    return v.documents.select("doc_id", F.md5(text.text_preview(F.col("text"))).alias("preview"))


@query("normalize_dollar", "select c_custkey, case when c_acctbal between 0.01 and 999999999.99 then printf('%.2f', c_acctbal) end as amount from customer")
def _(v):
    return v.customer.select("c_custkey", Q.normalize_dollar(F.concat(F.lit("$ "), F.format_number("c_acctbal", 2))).alias("amount"))
