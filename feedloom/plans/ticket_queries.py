"""Tickets, comments, lists, marketing and migration over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.operators import lists as L
from feedloom.operators import tickets as K
from feedloom.operators import triage as G
from feedloom.plans.registry import query

CATEGORIES = ["Billing", "Outage", "Other"]


@query("tickets_with_counts", "select tk.ticket_id, status, count(feedback_id) as n_feedback from tk left join tf on tf.ticket_id = tk.ticket_id where status in ('open', 'in_progress') group by 1, 2")
def _(v):
    return K.tickets_with_counts(v.tk, v.tf, ["open", "in_progress"]).select("ticket_id", "status", "n_feedback")


@query("ticket_detail", "select tk.ticket_id, coalesce(string_agg(cast(feedback_id as varchar), ',' order by tf.created_at, feedback_id), '') as feedback from tk left join tf on tf.ticket_id = tk.ticket_id group by 1")
def _(v):
    out = K.ticket_detail(v.tk, v.tf)
    return out.select("ticket_id", F.array_join(F.transform("feedback_ids", lambda x: x.cast("string")), ",").alias("feedback"))


@query(
    "status_view",
    """
with c as (select ticket_id, count(*) as n_comments, string_agg(cast(comment_id as varchar), ',' order by created_at, comment_id) as comment_ids from cm group by 1)
select feedback_id, tk.status as ticket_status, enrichment_status = 'pending' as analysis_in_progress, coalesce(n_comments, 0) as n_comments, coalesce(comment_ids, '') as comment_ids
from tf left join tk on tk.ticket_id = tf.ticket_id left join c on c.ticket_id = tf.ticket_id""",
)
def _(v):
    out = K.status_view(v.tf, v.tk, v.cm)
    ids = F.coalesce(F.array_join(F.transform("comments", lambda c: c.comment_id.cast("string")), ","), F.lit(""))
    return out.select("feedback_id", "ticket_status", "analysis_in_progress", F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("n_comments"), ids.alias("comment_ids"))


@query("submission_history", """
with t as (select c_custkey as submission_id, string_agg(o_orderpriority, ';' order by o_orderdate, o_orderkey) as steps from customer join orders on o_custkey = c_custkey group by 1)
select c_custkey as submission_id, coalesce(steps, '') as steps from customer left join t on t.submission_id = c_custkey""")
def _(v):
    moves = v.orders.select(F.col("o_custkey").alias("submission_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("id"), F.lit(0).alias("previous_state"), F.col("o_orderpriority").alias("new_state"))
    out = K.submission_history(v.customer.select(F.col("c_custkey").alias("submission_id")), moves)
    return out.select("submission_id", F.coalesce(F.array_join(F.transform("history", lambda h: h.new_state), ";"), F.lit("")).alias("steps"))


@query("review_queue", "select submission_id, created_at as queued_at, split_part(split_part(enrichment_result, '\"theme\":\"', 2), '\"', 1) as theme, cast(submission_id % 5 + 1 as int) as severity_score from sb where sentiment = 'neutral'")
def _(v):
    queue = v.sb.where("sentiment = 'neutral'").select("submission_id", F.col("created_at").alias("queued_at"))
    return K.review_queue(queue, v.sb.select("submission_id", "enrichment_result"))


@query("customer_open_tickets", "select customer_id, count(*) as open_links from rl join rt on rt.ticket_id = rl.ticket_id join fb on fb.feedback_id = rl.feedback_id where ticket_phase in ('new','triaged','routed','in_progress','waiting') group by 1")
def _(v):
    return G.customer_open_tickets(v.rt, v.rl, v.fb)


@query("latest_open_ticket_per_cluster", """select linked_cluster_id, ticket_id from (select *, row_number() over (partition by linked_cluster_id order by updated_at desc, ticket_id desc) as r
from rt where linked_cluster_id is not null and ticket_phase in ('new','triaged','routed','in_progress','waiting')) where r = 1""")
def _(v):
    return K.latest_open_ticket_per_cluster(v.rt)


@query("cluster_all_resolved", "select linked_cluster_id, count(*) filter (ticket_phase in ('new','triaged','routed','in_progress','waiting')) = 0 as all_resolved from rt where linked_cluster_id is not null group by 1")
def _(v):
    return K.cluster_all_resolved(v.rt)


@query("insight_lookup", "select l_orderkey as cluster_id, l_partkey as feedback_id, p_size as severity_score from lineitem left join (select * from part where p_size > 25) on p_partkey = l_partkey")
def _(v):
    members = v.lineitem.select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("feedback_id"))
    insights = v.part.where("p_size > 25").select(F.col("p_partkey").alias("feedback_id"), F.col("p_size").alias("severity_score"))
    return members.join(insights, "feedback_id", "left")


@query("cascade_delete", """
with p as (select * from tf where feedback_id % 50 = 1), g as (select distinct ticket_id from p where ticket_id is not null)
select 'tickets' as table_name, count(*) as removed from tk where ticket_id in (select ticket_id from g)
union all select 'comments', count(*) from cm where ticket_id in (select ticket_id from g)
union all select 'feedback', count(*) from tf where ticket_id in (select ticket_id from g) or feedback_id in (select feedback_id from p where ticket_id is null)""")
def _(v):
    return K.cascade_delete(v.tk, v.cm, v.tf, v.tf.where("feedback_id % 50 = 1").select("feedback_id"))["counts"]


@query("link_integrity", """select l_orderkey as feedback_id, l_partkey as ticket_id, case when p_partkey is null then 'unknown_ticket' when o_orderkey is null then 'unknown_feedback'
  when o_orderstatus = 'F' then 'already_linked' end as error from (select distinct l_orderkey + 3 as l_orderkey, l_partkey from lineitem)
  left join (select * from part where p_size <= 40) on p_partkey = l_partkey left join orders on o_orderkey = l_orderkey""")
def _(v):
    asked = v.lineitem.select((F.col("l_orderkey") + 3).alias("feedback_id"), F.col("l_partkey").alias("ticket_id")).distinct()
    feedback = v.orders.select(F.col("o_orderkey").alias("feedback_id"), "o_orderstatus")
    return K.link_integrity(asked, v.part.where("p_size <= 40").select(F.col("p_partkey").alias("ticket_id")), feedback, feedback.where("o_orderstatus = 'F'"))


@query("ticket_phase_transition", """
with recursive m as (select * from (values ('new','triaged'),('triaged','routed'),('routed','in_progress'),('in_progress','waiting'),('in_progress','resolved'),('waiting','in_progress'),('waiting','resolved'),('resolved','closed')) as t(a, b)),
q as (select l_orderkey as ticket_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k, cast(l_linenumber as bigint) as seq,
  case (l_partkey + l_suppkey) % 7 when 0 then 'triaged' when 1 then 'routed' when 2 then 'in_progress' when 3 then 'waiting' when 4 then 'resolved' when 5 then 'closed' else 'in_progress' end as new_phase,
  case when l_suppkey % 2 = 0 then 'resolved_by_agent' end as resolution_type from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey)),
s as (select q.*, rt.ticket_phase from q join rt on rt.ticket_id = q.ticket_id),
f as (select ticket_id, k, seq, ticket_phase as previous_phase, new_phase,
   case when not exists (select 1 from m where a = ticket_phase and b = new_phase) then 'invalid_transition' when new_phase = 'resolved' and resolution_type is null then 'resolution_type_required' end as error from s where k = 1
 union all
 select s.ticket_id, s.k, s.seq, case when f.error is null then f.new_phase else f.previous_phase end, s.new_phase,
   case when not exists (select 1 from m where a = case when f.error is null then f.new_phase else f.previous_phase end and b = s.new_phase) then 'invalid_transition' when s.new_phase = 'resolved' and s.resolution_type is null then 'resolution_type_required' end
 from f join s on s.ticket_id = f.ticket_id and s.k = f.k + 1)
select ticket_id, seq, previous_phase, new_phase, error from f""")
def _(v):
    phases = F.array(*map(F.lit, ["triaged", "routed", "in_progress", "waiting", "resolved", "closed", "in_progress"]))
    one = v.lineitem.groupBy(F.col("l_orderkey").alias("ticket_id"), F.col("l_linenumber").cast("long").alias("seq")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("p"))
    asked = one.select(
        "ticket_id", "seq", F.get(phases, (F.col("p.l_partkey") + F.col("p.l_suppkey")) % 7).alias("new_phase"),
        F.when(F.col("p.l_suppkey") % 2 == 0, "resolved_by_agent").alias("resolution_type"), F.lit("agent").alias("actor"),
    )
    return K.ticket_phase_transition(v.rt, asked).select("ticket_id", "seq", "previous_phase", "new_phase", "error")


@query("ticket_status_advance", """select o_orderkey as ticket_id, case o_orderkey % 3 when 0 then 'in_progress' when 1 then 'resolved' else 'open' end as new_status,
case when (o_orderstatus = 'O' and o_orderkey % 3 = 0) or (o_orderstatus = 'P' and o_orderkey % 3 = 1) then null else 'invalid_transition' end as error,
case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'We have started working on your ticket.' when o_orderstatus = 'P' and o_orderkey % 3 = 1 then 'Your ticket has been resolved.' end as text from orders""")
def _(v):
    status = F.when(F.col("ticket_id") % 3 == 0, "in_progress").when(F.col("ticket_id") % 3 == 1, "resolved").otherwise("open")
    asked = v.tk.select("ticket_id", status.alias("new_status"), F.col("created_at").alias("requested_at"))
    checked, said = K.ticket_status_advance(v.tk, asked)
    return checked.select("ticket_id", "new_status", "error").join(said.select("ticket_id", "text"), "ticket_id", "left")


@query("comment_add", "select comment_id, case when trim(text) = '' then 'blank_text' when o_orderkey is null then 'unknown_ticket' end as error from cm left join (select * from orders where o_orderkey % 3 <> 0) on o_orderkey = ticket_id")
def _(v):
    return K.comment_add(v.cm, v.tk.where("ticket_id % 3 <> 0")).select("comment_id", "error")


@query("progress_transition", "select feedback_id, customer_id, progress_step, coalesce(lag(progress_step) over (partition by customer_id order by feedback_id), 25) as previous_state from fb")
def _(v):
    moves = v.fb.select(F.col("customer_id").alias("submission_id"), F.col("feedback_id").alias("seq"), F.col("progress_step").alias("new_state"))
    out = K.progress_transition(moves, F.lit(25).cast("long"))
    return out.select(F.col("seq").alias("feedback_id"), F.col("submission_id").alias("customer_id"), F.col("new_state").alias("progress_step"), "previous_state")


@query("migrate_legacy", """
with lt as (select o_orderkey as ticket_id, o_custkey as submission_id from orders), nt as (select * from lt where ticket_id % 5 <> 0),
lk as (select submission_id, min(ticket_id) as ticket_id from lt group by 1), old as (select c_custkey as feedback_id from customer where c_custkey % 4 = 0),
f as (select s.submission_id as feedback_id, case when s.submission_id % 7 = 0 then 'review' when lk.ticket_id is not null then 'action_required' else 'review' end as triage_outcome, lk.ticket_id
 from (select c_custkey as submission_id from customer) s left join lk using (submission_id) where s.submission_id % 4 <> 0
 union all select old.feedback_id, 'kept', lk.ticket_id from old left join lk on lk.submission_id = old.feedback_id)
select feedback_id, triage_outcome, ticket_id from f""")
def _(v):
    legacy = v.tk.select("ticket_id", F.col("customer_id").alias("submission_id"), F.col("category").alias("issue_category"), "description", "priority", "status", "created_at")
    tickets = legacy.where("ticket_id % 5 = 0").select("ticket_id", F.col("issue_category").alias("category"), "description", "priority", "status", "created_at")
    subs = v.sb.select("submission_id", F.col("core_request").alias("text"), "created_at", "sentiment")
    none = F.lit(None).cast("long")
    old = subs.where("submission_id % 4 = 0").select(F.col("submission_id").alias("feedback_id"), "text", "created_at", "sentiment", F.lit("kept").alias("triage_outcome"), F.lit(False).alias("needs_review"), none.alias("ticket_id"))
    return K.migrate_legacy(legacy, subs, subs.where("submission_id % 7 = 0"), tickets, old)["feedback"].select("feedback_id", "triage_outcome", "ticket_id")


@query("marketing_log", """select submission_id, customer_name, case when social_sharing then 'shared' else 'internal_only' end as social_status,
case when social_sharing then 'https://example.com/praise/' || submission_id end as shareable_url,
case when social_sharing then regexp_replace(regexp_replace(replace(praise_text, customer_name, '[CUSTOMER]'), '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b', '[EMAIL REMOVED]', 'g'), '\\+?\\d[\\d\\s\\-().]{5,14}\\d', '[PHONE REMOVED]', 'g') end as share_text
from sb where sentiment = 'positive'""")
def _(v):
    return K.marketing_log(v.sb, "https://example.com/praise")


NEWEST = "order by created_at desc, feedback_id"


@query("list_by", f"select feedback_id from fb where needs_review {NEWEST} limit 50 offset 10")
def _(v):
    return L.list_by(v.fb, F.col("needs_review"), 50, 10).select("feedback_id")


@query("paginate", f"""with p as (select feedback_id from fb {NEWEST} limit 20 offset 40)
select feedback_id, 3 as page, 41::bigint as page_from, 60::bigint as page_to, cast(ceil((select count(*) from fb) / 20) as bigint) as pages from p""")
def _(v):
    return L.paginate(v.fb, 20, 40).select("feedback_id", "page", "page_from", "page_to", "pages")


SORTED = "select feedback_id, severity, row_number() over (order by severity desc nulls last, feedback_id) as position from fb"


@query("sort_nulls_last", SORTED)
def _(v):
    return L.positions(L.sort_nulls_last(v.fb.select("feedback_id", "severity"), "severity", descending=True, tie="feedback_id"))


@query("sort_nulls_last_all", SORTED)
def _(v):
    return L.positions(L.sort_nulls_last(v.fb.select("feedback_id", "severity"), "severity", descending=True, tie="feedback_id"))


@query("sort_text_nulls_last", r"""with k as (select id, name, array_to_string(list_transform(regexp_extract_all(name, '\d+|\D+'),
 lambda p: case when regexp_matches(p, '^\d') then lpad(length(ltrim(p, '0'))::varchar, 10, '0') || ltrim(p, '0') else p end), '') as key from nm)
select id, name, row_number() over (order by icu_sort_key(key, 'en') nulls last, id) as position from k""")
def _(v):
    return L.positions(L.sort_nulls_last(v.nm, "name", tie="id", collation="UNICODE"))


@query("filter_feedback", "select feedback_id from fb where sentiment = 'negative' and contains(lower(text || ' ' || coalesce(location_city, '')), 'system down')")
def _(v):
    return L.filter_feedback(v.fb, " System DOWN ", sentiment="negative", columns=("text", "location_city")).select("feedback_id")


@query("filter_tickets", "select tk.ticket_id from tk join tf on tf.ticket_id = tk.ticket_id where status = 'open' and contains(description, '7') group by 1 having count(*) > 1")
def _(v):
    return L.filter_tickets(K.tickets_with_counts(v.tk, v.tf), "open", True, "7").select("ticket_id")


@query("filter_marketing", "select submission_id from sb where sentiment = 'positive' and praise_text is not null and contains(lower(customer_name || ' ' || praise_text), '#0000001')")
def _(v):
    return L.filter_marketing(v.sb.where("sentiment = 'positive'"), True, "#0000001").select("submission_id")


@query("mentioned_names", f"""with n as (select distinct feedback_id, unnest(regexp_extract_all(text, '{R.PRAISE_CUE}', 1)) as name from fb)
select min(name) as name, count(distinct feedback_id) as n from n where len(list_filter(string_split_regex(lower(name), '\\s+'), lambda p: not list_contains({R.NOT_NAMES}, p))) > 0 group by lower(name)""")
def _(v):
    return L.praise_leaderboard(v.fb).select("name", "n")
