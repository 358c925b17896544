"""Triage, priority and routing over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import triage as G
from feedloom.plans.dashboard_queries import rounded
from feedloom.plans.registry import query

DECIDE = """case when enrichment_status <> 'completed' then 'review' when sentiment = 'negative' and severity_score >= 3 then 'action_required'
 when sentiment in ('positive', 'neutral') and severity_score <= 2 then 'no_action' else 'review' end"""
ANY = "regexp_matches(lower(text), '{}')"
OUTAGE = ANY.format("outage|service down|system down|not working for everyone|widespread issue")
ESCALATE = ANY.format("ceo|executive|lawyer|attorney|fcc|regulatory|lawsuit")
ACTION = "intent in ('complaint', 'request_for_help', 'billing_dispute')"
# priority with cluster volume
PRIORITY = f"""
vol as (select feedback_id, feedback_id % 15 as volume from fb),
pr as (select fb.*, volume, {OUTAGE} as outage, {ESCALATE} as escalation, abs(sentiment_score) as size, {ACTION} as action from fb join vol on vol.feedback_id = fb.feedback_id),
pl as (select *, case when (outage and sentiment_score < -0.7) or escalation then 'critical' when sentiment_score < -0.5 or volume > 10 then 'high'
  when (sentiment_score >= -0.5 and sentiment_score < -0.2) or intent in ('request_for_help', 'billing_dispute') then 'medium' else 'low' end as priority_level from pr),
ps as (select *, case priority_level
  when 'critical' then least(1.0, 0.75 + case when outage and sentiment_score < -0.7 and escalation then 0.25 when escalation then case when sentiment_score < -0.8 then 0.2 else 0.15 end else 0.1 + least(1.0, size - 0.7) / 0.3 * 0.1 end)
  when 'high' then least(0.74, 0.5 + case when sentiment_score < -0.5 then least(1.0, (size - 0.5) / 0.2) * 0.12 else 0 end + case when volume > 10 then least(1.0, (volume - 10) / 40.0) * 0.12 else 0 end)
  when 'medium' then least(0.49, 0.25 + case when sentiment_score >= -0.5 and sentiment_score < -0.2 then (size - 0.2) / 0.3 * 0.12 else 0 end + case when intent in ('request_for_help', 'billing_dispute') then 0.1 else 0 end)
  else least(0.24, case when sentiment_score < 0 then least(1.0, size / 0.2) * 0.12 else 0 end + case when action then 0.06 else 0 end) end as priority_score from pl)"""


def score(fb):
    action = F.col("intent").isin("complaint", "request_for_help", "billing_dispute")
    p = G.priority_score(F.col("text"), F.col("sentiment_score"), F.col("intent"), action, F.col("feedback_id") % 15)
    return fb.withColumns({"_p": p, "requires_action": action}).select("*", "_p.*").drop("_p")


def scored(v):
    return score(v.fb)


@query("triage_decide", f"select feedback_id, {DECIDE} as outcome from fb")
def _(v):
    return v.fb.select("feedback_id", G.triage_decide(F.col("enrichment_status"), F.col("sentiment"), F.col("severity_score")).alias("outcome"))


@query("run_triage", f"""select feedback_id, case when enrichment_status = 'completed' and triage_outcome is null then {DECIDE} else triage_outcome end as triage_outcome,
 case when enrichment_status = 'completed' and triage_outcome is null and ({DECIDE}) = 'action_required' and ticket_id is null then sha256('ticket:' || feedback_id) else cast(ticket_id as varchar) end as ticket_id,
 case when enrichment_status = 'completed' and triage_outcome is null and ({DECIDE}) = 'action_required' and ticket_id is null then theme end as opened_category from fb""")
def _(v):
    rows, tickets = G.run_triage(v.fb.withColumn("theme_labels", F.array("theme")))
    opened = tickets.select("ticket_id", F.col("category").alias("opened_category"))
    return rows.select("feedback_id", "triage_outcome", "ticket_id").join(opened, "ticket_id", "left").select("feedback_id", "triage_outcome", "ticket_id", "opened_category")


@query("manual_triage", """
with d as (select event_id as feedback_id, case event_id % 3 when 0 then 'link' when 1 then 'create' else 'no_action' end as action, cast(event_id % 30 as varchar) as target from events where event_id % 7 = 0),
ok as (select * from d where not (action = 'link' and target = '3'))
select fb.feedback_id, case when action = 'no_action' then 'no_action' when action is not null then 'action_required' else triage_outcome end as triage_outcome,
 case action when 'link' then target when 'create' then sha256('ticket:' || fb.feedback_id) when 'no_action' then null else cast(ticket_id as varchar) end as ticket_id from fb left join ok on ok.feedback_id = fb.feedback_id""")
def _(v):
    k = F.col("event_id")
    one = v.events.where(k % 7 == 0)
    pick = F.when(k % 3 == 0, "link").when(k % 3 == 1, "create").otherwise("no_action")
    late = one.select(k.alias("feedback_id"), F.lit(2).alias("decided_at"), pick.alias("action"), (k % 30).cast("string").alias("target_ticket"))
    early = one.select(k.alias("feedback_id"), F.lit(1).alias("decided_at"), F.lit("no_action").alias("action"), F.lit("9").alias("target_ticket"))
    tickets = v.spark.range(30).where("id <> 3").select(F.col("id").cast("string").alias("ticket_id"))
    rows, _ = G.manual_triage(v.fb, early.unionByName(late), tickets)
    return rows.select("feedback_id", "triage_outcome", "ticket_id")


@query("sentiment_route", "select feedback_id, case sentiment when 'negative' then 'ticket' when 'positive' then 'marketing_log' when 'neutral' then 'review_queue' end as target from fb")
def _(v):
    return v.fb.select("feedback_id", G.sentiment_route(F.col("sentiment")).alias("target"))


@query("priority_score", f"with {PRIORITY} select feedback_id, priority_level, round(priority_score, 6) as priority_score from ps")
def _(v):
    return rounded(scored(v).select("feedback_id", "priority_level", "priority_score"), "priority_score")


@query("department_map", """select feedback_id, case when source_type = 'social' and customer_id * 3 > 100 then 'Social_Media_Care' when theme = 'outage' then 'Network_Operations' when theme = 'billing' then 'Billing_Support'
 when theme = 'installation' then 'Field_Operations' when theme = 'app_usability' then 'Digital_Product' else 'Customer_Care' end as department from fb""")
def _(v):
    social = F.when(F.col("source_type") == "social", F.col("customer_id") * 3)
    return v.fb.select("feedback_id", G.department_map(F.col("theme"), F.col("intent"), social).alias("department"))


# the sequential rules as a recursion over each cluster's records in order
ROUTE = f"""
with recursive {PRIORITY.strip()},
ol as (select customer_id, count(*) as n from rl join rt on rt.ticket_id = rl.ticket_id join fb on fb.feedback_id = rl.feedback_id where ticket_phase in ('new','triaged','routed','in_progress','waiting') group by 1),
st as (select linked_cluster_id as cluster_id, count(*) filter (ticket_phase in ('new','triaged','routed','in_progress','waiting')) as n_open,
  cast(max_by(ticket_id, (updated_at, ticket_id)) filter (ticket_phase in ('new','triaged','routed','in_progress','waiting')) as varchar) as ticket from rt where linked_cluster_id is not null group by 1),
x as (select ps.feedback_id, ps.cluster_id, coalesce(cast(ps.cluster_id as varchar), 'r' || ps.feedback_id) as grp, ps.cluster_id is not null as has_cluster,
  row_number() over (partition by coalesce(cast(ps.cluster_id as varchar), 'r' || ps.feedback_id) order by created_at, ps.feedback_id) as r,
  priority_level = 'critical' or regexp_matches(lower(text), 'lawyer|attorney|lawsuit|fcc|regulatory|legal action|class action') or (ps.customer_id % 3 = 0 and coalesce(ol.n, 0) >= 3) or (source_type = 'social' and ps.customer_id * 30 > 1000) as esc,
  action and priority_level in ('medium', 'high') as cre, st.ticket as first_open, st.cluster_id is not null and n_open = 0 as all_done, intent, priority_level, action, theme
  from ps left join ol on ol.customer_id = ps.customer_id left join st on st.cluster_id = ps.cluster_id),
w as (select *, 1 as dummy, case when esc then 'escalate' when has_cluster and first_open is not null then 'route_to_existing' when cre then 'create_ticket' else 'auto_resolve' end as act, first_open as seen from x where r = 1
  union all
  select x.*, 1, case when x.esc then 'escalate' when coalesce(case when w.act in ('escalate', 'create_ticket') then sha256('ticket:' || w.feedback_id) end, w.seen) is not null then 'route_to_existing' when x.cre then 'create_ticket' else 'auto_resolve' end,
   coalesce(case when w.act in ('escalate', 'create_ticket') then sha256('ticket:' || w.feedback_id) end, w.seen)
  from w join x on x.grp = w.grp and x.r = w.r + 1)"""


def to_route(fb):
    """Feedback with the columns that routing reads."""
    return score(fb).withColumns(
        {
            "ts": F.col("created_at"),
            "account_type": F.when(F.col("customer_id") % 3 == 0, "high_value").otherwise("basic"),
            "engagement": F.col("customer_id") * 30,
            "theme_primary": F.col("theme"),
            "duplicate_count": F.lit(0),
        }
    )


def routed(v):
    rows = to_route(v.fb)
    return rows, G.routing_decision(rows, v.rt, v.rl)


@query("routing_decision", ROUTE + """
select feedback_id, act as routing_action, case when act = 'route_to_existing' then seen end as linked_ticket_id,
 case when act <> 'auto_resolve' then null when intent = 'praise' and priority_level = 'low' and not action then 'no_action_required' when has_cluster and (all_done or r > 1) and seen is null then 'known_resolved'
  when intent = 'request_for_help' and priority_level = 'low' and theme in ('billing', 'installation', 'app_usability', 'support_experience') then 'faq_matched' else 'no_action_required' end as resolution_type from w""")
def _(v):
    return routed(v)[1].select("feedback_id", "routing_action", "linked_ticket_id", "resolution_type")


@query("route_in_order", ROUTE + "select feedback_id, cluster_id, seen is not null as open_before from w where has_cluster")
def _(v):
    out = routed(v)[1].where("cluster_id is not null")
    from pyspark.sql import Window

    before = Window.partitionBy("cluster_id").orderBy("ts", "feedback_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.col("routing_action").isin("escalate", "create_ticket")
    state = G.cluster_ticket_state(v.rt).where("open_ticket_id is not null").select("cluster_id", F.lit(True).alias("_open"))
    seen = F.coalesce(F.max(opened).over(before), F.lit(False))
    return out.withColumn("_seen", seen).join(state, "cluster_id", "left").select("feedback_id", "cluster_id", (F.col("_seen") | F.coalesce("_open", F.lit(False))).alias("open_before"))


@query("persist_star", ROUTE + """
select 'feedback' as table_name, count(*) as n from w union all select 'analysis', count(*) from w union all select 'links', count(*) from w
union all select 'tickets', count(*) from w where act <> 'route_to_existing'""")
def _(v):
    rows, out = routed(v)
    star = G.persist_star(out, rows)
    counted = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in star.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
