"""Feedback views over the given tables.

Each view is SQL that Spark and DuckDB read alike; Spark fills in DataFrames, an oracle query
gets the views it names as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # unified feedback
    "fb": """
select event_id as feedback_id, cast(ts as timestamp) as created_at, user_id as customer_id,
  case when event_id % 3 = 0 then 'social' else 'direct' end as source_type,
  case when event_id % 3 = 0 then case event_id % 9 when 0 then 'reddit' when 3 then 'x' else 'facebook' end end as platform,
  case when event_id % 3 <> 0 then 'web_form' end as channel,
  case event_type when 'error' then 'outage' when 'purchase' then 'billing' when 'click' then 'app_usability'
    when 'signup' then 'installation' else 'support_experience' end as theme,
  cast(cast(floor(value / 10) as bigint) % 5 + 1 as int) as severity_score,
  case when cast(floor(value) as bigint) % 10 <= 4 then 'negative' when cast(floor(value) as bigint) % 10 <= 6 then 'neutral'
    when cast(floor(value) as bigint) % 10 <= 8 then 'positive' end as sentiment,
  cast(cast(floor(value) as bigint) % 201 - 100 as double) / 100 as sentiment_score,
  cast(event_id % 50 as double) / 50 as sentiment_confidence,
  cast(event_id % 41 as double) / 40 as theme_confidence,
  case when event_id % 20 = 0 then 'failed' when event_id % 20 = 1 then 'timeout' when event_id % 20 = 2 then 'pending' else 'completed' end as enrichment_status,
  case when event_id % 4 = 0 then event_id % 40 end as ticket_id,
  case event_type when 'error' then 'Network Operations' when 'purchase' then 'Billing' when 'click' then 'Customer Support'
    when 'signup' then 'Field Services' else '' end as department,
  case when event_id % 11 <> 0 then cast((cast(floor(value / 10) as bigint) % 5 + 1) * 2 as int) end as severity,
  case event_id % 4 when 0 then 'action_required' when 1 then 'no_action' when 2 then 'review' end as triage_outcome,
  event_id % 3 = 1 as needs_review,
  case user_id % 5 when 0 then 'TX' when 1 then 'FL' when 2 then 'OH' when 3 then 'NC' end as location_state,
  case user_id % 5 when 0 then 'Austin' when 1 then 'Tampa' when 2 then 'Columbus' when 3 then 'Charlotte' end as location_city,
  case when event_id % 6 <> 0 then cast(25 + user_id % 5 * 3 as double) + cast(event_id % 7 as double) / 10 end as latitude,
  case when event_id % 6 <> 0 then cast(-100 + user_id % 5 * 4 as double) + cast(event_id % 5 as double) / 10 end as longitude,
  case event_id % 5 when 0 then 'complaint' when 1 then 'request_for_help' when 2 then 'billing_dispute' when 3 then 'praise' else 'feature_suggestion' end as intent,
  case event_id % 8 when 7 then cast(null as bigint) else event_id % 25 end as cluster_id,
  case event_id % 3 when 0 then 'en' when 1 then 'es' else 'fr' end as language_code,
  user_id % 4 as progress_step,
  concat('b', cast(event_id % 12 as varchar(9))) as batch_id,
  case event_id % 16
    when 0 then concat('Total outage here, service down since Monday. Call me at 555-123-4567 please, ref ', cast(event_id % 5 as varchar(9)))
    when 1 then 'My bill is wrong again! Contact jane.doe@example.com about the $1,234.50 charge'
    when 2 then 'Thanks to Marcus for the quick fix, great support'
    when 3 then '<b>App</b> keeps crashing &  the  screen is   blank'
    when 4 then 'I will call my lawyer and the FCC about this'
    when 5 then 'the internet is very slow and this was the same with the modem'
    when 6 then 'la factura es muy alta para este mes y no puede ser'
    when 7 then 'technician James was late, damn it'
    when 8 then 'la connexion est lente dans tout le quartier avec des pannes'
    when 9 then 'ok'
    when 10 then '  SSN 123-45-6789 was printed on the letter  '
    when 11 then 'der Techniker ist nicht gekommen und das Internet ist aus'
    when 12 then 'Kudos to Sarah Miller and thanks to Sarah Miller for help from agent Bob Stone'
    when 13 then ''
    when 14 then concat('please cancel my plan ', cast(user_id % 7 as varchar(9)))
    else concat('system down, not working for everyone in unit ', cast(event_id % 3 as varchar(9))) end as text
from events""",
    # tickets of the product, from orders
    "tk": """
select o_orderkey as ticket_id, case o_orderstatus when 'O' then 'open' when 'P' then 'in_progress' else 'resolved' end as status,
  o_orderpriority as priority, cast(o_orderdate as timestamp) as created_at, o_custkey as customer_id,
  case o_orderkey % 3 when 0 then 'outage' when 1 then 'billing' else 'general' end as category,
  concat('order ', cast(o_orderkey as varchar(20))) as description
from orders""",
    # feedback linked to tickets, from line items
    "tf": """
select l_orderkey * 10 + l_linenumber as feedback_id, case when l_linenumber <= 4 then l_orderkey end as ticket_id, cast(l_shipdate as timestamp) as created_at, l_partkey as customer_id,
  case l_returnflag when 'A' then 'pending' when 'N' then 'completed' else 'failed' end as enrichment_status
from lineitem""",
    # comments on tickets, from conversations
    "cm": """
select conv_id * 100 + turn as comment_id, conv_id as ticket_id, text, role as author,
  cast('2024-01-01 00:00:00' as timestamp) + interval 1 minute * cast(turn as int) as created_at
from conversations""",
    # tickets of the routing pipeline: every order; clusters that 5 divides have none, some only closed ones
    "rt": """
select o_orderkey as ticket_id,
  case when o_orderkey % 40 in (3, 8, 13, 18, 23) then case o_orderkey % 3 when 0 then 'resolved' when 1 then 'closed' else 'auto_closed' end
    else case o_orderkey % 8 when 0 then 'new' when 1 then 'triaged' when 2 then 'routed' when 3 then 'in_progress' when 4 then 'waiting'
      when 5 then 'resolved' when 6 then 'closed' else 'auto_closed' end end as ticket_phase,
  case o_orderkey % 3 when 0 then 'Billing_Support' when 1 then 'Customer_Care' else 'Retention' end as assigned_department,
  cast(o_orderdate as timestamp) as created_at, cast(o_orderdate as timestamp) as updated_at,
  case when o_orderkey % 5 <> 0 then o_orderkey % 40 end as linked_cluster_id,
  'low' as priority_level
from orders""",
    # links of feedback to routing tickets: a third of the social feedback is linked, as not all of it becomes a ticket
    "rl": "select event_id as feedback_id, event_id % 97 * 16 + 1 as ticket_id from events where event_id % 6 = 0",
    # clusters of the routing pipeline: the even events are those that were assigned so far, the odd ones come later
    "cl": """
select user_id as cluster_id, max(case event_type when 'error' then 'outage' when 'purchase' then 'billing' else 'installation' end) as theme,
  count(*) as volume_count, cast(min(ts) as timestamp) as first_seen_at, cast(max(ts) as timestamp) as last_seen_at,
  case user_id % 3 when 0 then 'active' when 1 then 'monitoring' else 'resolved' end as status,
  case user_id % 2 when 0 then 'low' else 'high' end as priority_level,
  concat('summary ', cast(user_id as varchar(9))) as cluster_summary
from events where event_id % 2 = 0 group by user_id""",
    # widget payloads made of the columns, right and wrong ones
    "wp": """
select event_id, case when cast(floor(value) as bigint) % 11 = 0 then substr(whole, 1, length(whole) - 1) else whole end as payload from (
  select event_id, value, concat('{"message_text": ',
    case user_id % 6 when 0 then 'null' when 1 then cast(user_id as varchar(20)) when 2 then '"  "' when 3 then concat('"', repeat(event_type, cast(floor(value * 50) as int)), '"')
      else concat('"', event_type, ' at ', cast(cast(floor(value) as bigint) as varchar(20)), '"') end,
    case event_id % 5 when 0 then '' when 1 then ', "consent_to_contact": "yes"' when 2 then concat(', "consent_to_contact": ', cast(event_id as varchar(20))) when 3 then ', "consent_to_contact": true' else ', "consent_to_contact": false' end,
    case event_type when 'error' then ', "selected_category": "outage"' when 'purchase' then ', "selected_category": "billing"' when 'click' then '' else concat(', "selected_category": "', event_type, '"') end,
    case user_id % 4 when 0 then ', "submission_channel": "chat"' when 1 then concat(', "submission_channel": "', event_type, '"') else '' end, '}') as whole
  from events) as w""",
    # analysis rows as JSON made of the columns, right and wrong ones
    "js": """
select event_id, case when cast(floor(value) as bigint) % 13 = 0 then concat('[', whole) else whole end as json from (
  select event_id, value, concat('{"feedback_id": ', case user_id % 9 when 0 then 'null' when 1 then concat('"f', cast(event_id as varchar(20)), '"') else cast(event_id as varchar(20)) end,
    ', "sentiment_label": "', case event_type when 'error' then 'negative' when 'purchase' then 'neutral' when 'click' then 'positive' when 'signup' then 'neutral' else event_type end,
    '", "sentiment_score": ', case user_id % 7 when 0 then concat('"', cast(event_id as varchar(20)), '"') when 1 then cast(cast(floor(value) as bigint) as varchar(20)) else concat('-0.', cast(event_id as varchar(20))) end,
    ', "processed_at": "', substr(cast(cast(ts as date) as varchar(20)), 1, 10), case user_id % 5 when 0 then ' ' else 'T' end, '00:00:00', case event_id % 6 when 0 then '' when 1 then '.25Z' else 'Z' end, '"}') as whole
  from events) as w""",
    # names with accents, numbers, capitals and nulls
    "nm": """
select p_partkey as id, case p_partkey % 9 when 0 then null when 1 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ', cast(p_partkey % 120 as varchar(9)))
  when 2 then concat(replace(replace(p_name, 'e', 'é'), 'a', 'ä'), ' ', cast(p_partkey % 120 as varchar(9))) else concat(p_name, ' ', cast(p_partkey % 120 as varchar(9))) end as name from part
union all select 1000000000 + c_custkey as id, c_name as name from customer""",
    # legacy submissions
    "sb": """
select c_custkey as submission_id, c_name as customer_name, concat('c', cast(c_custkey as varchar(20)), '@example.com') as email,
  case when c_custkey % 4 <> 0 then concat('+1', cast(5550000000 + c_custkey as varchar(20))) else '12' end as phone,
  case when c_custkey % 10 <> 0 then concat('please help with ', lower(c_mktsegment)) else '' end as core_request,
  case c_custkey % 4 when 0 then 'negative' when 1 then 'positive' when 2 then 'neutral' else 'angry' end as sentiment,
  case c_custkey % 3 when 0 then 'Billing' when 1 then 'Outage' end as issue_category,
  case when c_custkey % 5 = 0 then 'short' else concat('long enough description ', c_name) end as detailed_description,
  case when c_custkey % 6 <> 1 then concat('Thanks to Marcus! I am ', c_name, ', write to x', cast(c_custkey as varchar(20)), '@example.com or +1 (555) 123-4567') end as praise_text,
  case when c_custkey % 7 = 2 then '   ' else 'a comment' end as comment_text,
  c_custkey % 2 = 1 as social_sharing,
  case c_custkey % 4 when 0 then 25 when 1 then 50 when 2 then 75 else 100 end as progress_state,
  cast('2024-01-01 00:00:00' as timestamp) + interval 1 minute * cast(c_custkey as int) as created_at,
  concat('{"themes":[{"theme":"', lower(c_mktsegment), '"}],"severity_score":', cast(c_custkey % 5 + 1 as varchar(9)), '}') as enrichment_result
from customer""",
}
_SOURCE = re.compile(r"\b(from|join) (%s)\b" % "|".join([*VIEWS, *TABLES]))


def _needs(sql: str) -> list[str]:
    """Views that a text names, those they name first."""
    out: list[str] = []
    for name in dict.fromkeys(t for _, t in _SOURCE.findall(sql)):
        if name in VIEWS:
            out += [x for x in [*_needs(VIEWS[name]), name] if x not in out]
    return out


def oracle(sql: str) -> str:
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in _needs(sql)]
    body = sql.strip()
    if not ctes:
        return body
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{', '.join(ctes)}, {body[len(start) :]}"
    return f"with {', '.join(ctes)}\n{body}"


class Views:
    """The given tables and the views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over views and tables that the text names."""
        tables = {t: getattr(self, t) for _, t in dict.fromkeys(_SOURCE.findall(text))}
        return self.spark.sql(_SOURCE.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}")), **tables)
