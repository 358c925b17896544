"""Review flags, triage, priority and the routing of feedback to tickets and departments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.functions.display import issue_category


def needs_review(sentiment_confidence: Column, themes: Column, least: float = 0.70) -> Column:
    return (sentiment_confidence < least) | F.exists(themes, lambda t: t.confidence < least)


def triage_decide(status: Column, sentiment: Column, severity: Column, action_from: int = 3, calm_to: int = 2) -> Column:
    return (
        F.when((status != "completed") | status.isNull(), "review")
        .when((sentiment == "negative") & (severity >= action_from), "action_required")
        .when(sentiment.isin("positive", "neutral") & (severity <= calm_to), "no_action")
        .otherwise("review")
    )


def ticket_id(feedback_id: Column) -> Column:
    """The same for every run over the same feedback."""
    return F.sha2(F.concat(F.lit("ticket:"), feedback_id.cast("string")), 256)


def run_triage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with triage columns, new tickets) for completed feedback without a decision."""
    due = (F.col("enrichment_status") == "completed") & F.col("triage_outcome").isNull()
    outcome = triage_decide(F.col("enrichment_status"), F.col("sentiment"), F.col("severity_score"))
    opens = due & (outcome == "action_required")
    out = rows.withColumns(
        {
            "ticket_id": F.when(opens & F.col("ticket_id").isNull(), ticket_id(F.col("feedback_id"))).otherwise(F.col("ticket_id").cast("string")),
            "needs_review": F.when(due, outcome == "review").otherwise(F.col("needs_review")),
            "triage_decision_source": F.when(due, "auto"),
            "_opened": opens & F.col("ticket_id").isNull(),
            "triage_outcome": F.when(due, outcome).otherwise(F.col("triage_outcome")),
        }
    )
    tickets = out.where("_opened").select(
        "ticket_id",
        issue_category(F.col("theme_labels")).alias("category"),
        F.substring("text", 1, 5000).alias("description"),
        F.lit("high").alias("priority"),
        F.lit("open").alias("status"),
        "created_at",
    )
    return out.drop("_opened"), tickets


def manual_triage(rows: DataFrame, decisions: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the latest admin decision applied, decisions with an unknown ticket).

    ``decisions(feedback_id, decided_at, action, target_ticket)``; action is link, create or
    no_action."""
    latest = decisions.groupBy("feedback_id").agg(F.max(F.struct("decided_at", "action", "target_ticket")).alias("d")).select("feedback_id", "d.*")
    broken = latest.where("action = 'link'").join(tickets.select(F.col("ticket_id").alias("target_ticket")), "target_ticket", "left_anti")
    good = latest.join(broken.select("feedback_id"), "feedback_id", "left_anti")
    joined = rows.join(good, "feedback_id", "left")
    decided = F.col("action").isNotNull()
    link = F.when(F.col("action") == "link", F.col("target_ticket")).when(F.col("action") == "create", ticket_id(F.col("feedback_id")))
    out = joined.withColumns(
        {
            "ticket_id": F.when(decided, link).otherwise(F.col("ticket_id").cast("string")),
            "triage_outcome": F.when(F.col("action") == "no_action", "no_action").when(decided, "action_required").otherwise(F.col("triage_outcome")),
            "needs_review": F.when(decided, False).otherwise(F.col("needs_review")),
            "triage_decision_source": F.when(decided, "admin").otherwise(F.lit(None)),
        }
    )
    return out.drop("decided_at", "action", "target_ticket"), broken


def sentiment_route(sentiment: Column) -> Column:
    return F.when(sentiment == "negative", "ticket").when(sentiment == "positive", "marketing_log").when(sentiment == "neutral", "review_queue")


def _any(text: Column, words: list[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def priority_score(text: Column, score: Column, intent: Column, action: Column, volume: Column) -> Column:
    """(priority_level, priority_score): the first level whose rule holds, with its own formula."""
    outage, escalation = _any(text, R.OUTAGE_WORDS), _any(text, R.ESCALATION_WORDS)
    severe = score < -0.7
    size, one = F.abs(score), F.lit(1.0)
    medium_mood, medium_intent = (score >= -0.5) & (score < -0.2), intent.isin(R.MEDIUM_INTENTS)
    volume = F.coalesce(volume, F.lit(0))
    critical = (
        F.when(outage & severe & escalation, 0.25)
        .when(escalation, F.when(score < -0.8, 0.20).otherwise(0.15))
        .when(outage & severe, 0.10 + F.least(one, size - 0.7) / 0.3 * 0.10)
    )
    high = F.when(score < -0.5, F.least(one, (size - 0.5) / 0.2) * 0.12).otherwise(0.0) + F.when(
        volume > 10, F.least(one, (volume - 10) / 40.0) * 0.12
    ).otherwise(0.0)
    medium = F.when(medium_mood, (size - 0.2) / 0.3 * 0.12).otherwise(0.0) + F.when(medium_intent, 0.10).otherwise(0.0)
    low = F.when(score < 0, F.least(one, size / 0.2) * 0.12).otherwise(0.0) + F.when(action, 0.06).otherwise(0.0)

    def level(name: str, base: float, most: float, bonus: Column) -> Column:
        return F.struct(F.lit(name).alias("priority_level"), F.least(F.lit(most), base + bonus).alias("priority_score"))

    return (
        F.when((outage & severe) | escalation, level("critical", 0.75, 1.0, critical))
        .when((score < -0.5) | (volume > 10), level("high", 0.50, 0.74, high))
        .when(medium_mood | medium_intent, level("medium", 0.25, 0.49, medium))
        .otherwise(level("low", 0.0, 0.24, low))
    )


def department_map(theme: Column, intent: Column, social_engagement: Column) -> Column:
    def table(m: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.coalesce(key, F.lit("")))

    viral = F.when(social_engagement > 100, "Social_Media_Care")
    return F.coalesce(viral, table(R.THEME_DEPARTMENT, theme), table(R.INTENT_DEPARTMENT, intent), F.lit("Customer_Care"))


def customer_open_tickets(tickets: DataFrame, links: DataFrame, feedback: DataFrame) -> DataFrame:
    """Links to open tickets per customer."""
    open_ = tickets.where(F.col("ticket_phase").isin(R.OPEN_PHASES)).select("ticket_id")
    linked = links.join(open_, "ticket_id").join(feedback.select("feedback_id", "customer_id"), "feedback_id")
    return linked.groupBy("customer_id").agg(F.count("*").alias("open_links"))


def cluster_ticket_state(tickets: DataFrame) -> DataFrame:
    """Per cluster: the open ticket that was updated last, its department, and whether all are
    resolved.  Of one time the ticket of the greatest ``opened_by`` counts, if there is this column."""
    is_open = F.col("ticket_phase").isin(R.OPEN_PHASES)
    order = ["updated_at", "opened_by"] if "opened_by" in tickets.columns else ["updated_at"]
    one = F.when(is_open, F.struct(*order, "ticket_id", F.col("assigned_department").alias("department")))
    return (
        tickets.where("linked_cluster_id is not null")
        .groupBy(F.col("linked_cluster_id").alias("cluster_id"))
        .agg(F.max(one).alias("t"), (F.count_if(is_open) == 0).alias("all_resolved"))
        .select("cluster_id", F.col("t.ticket_id").alias("open_ticket_id"), F.col("t.department").alias("open_department"), "all_resolved")
    )


def routing_decision(rows: DataFrame, tickets: DataFrame, links: DataFrame | None = None, open_links: DataFrame | None = None) -> DataFrame:
    """Routes every row in (time, id) order of its cluster: later rows see tickets that earlier
    ones opened.

    ``rows`` has feedback_id, ts, customer_id, account_type, source_type, engagement, text,
    theme_primary, intent, priority_level, requires_action, duplicate_count and cluster_id.  The
    rule on a customer's open links looks at the tickets as they are at the start: it takes
    ``open_links(customer_id, open_links)``, or counts ``links`` of these rows.  A row without a
    cluster stands alone.
    """
    state = cluster_ticket_state(tickets)
    counted = customer_open_tickets(tickets, links, rows) if open_links is None else open_links
    joined = rows.join(counted, "customer_id", "left").join(state, "cluster_id", "left")
    social = F.when(F.col("source_type") == "social", F.coalesce("engagement", F.lit(0)))
    escalates = F.coalesce(
        (F.col("priority_level") == "critical")
        | _any(F.col("text"), R.LEGAL_WORDS)
        | ((F.col("account_type") == "high_value") & (F.coalesce("open_links", F.lit(0)) >= 3))
        | (F.coalesce(social, F.lit(0)) > 1000),
        F.lit(False),
    )
    creates = F.coalesce(F.col("requires_action") & F.col("priority_level").isin("medium", "high"), F.lit(False))
    marked = joined.withColumns({"_escalates": escalates, "_creates": creates, "_new": ticket_id(F.col("feedback_id"))})
    alone = F.when(F.col("cluster_id").isNull(), F.col("feedback_id").cast("string"))
    order = Window.partitionBy("cluster_id", "_alone").orderBy("ts", "feedback_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("_escalates") | F.col("_creates")
    marked = marked.withColumn("_alone", alone)
    marked = marked.withColumn("_open_before", F.col("open_ticket_id").isNotNull() | F.coalesce(F.max(opens).over(before), F.lit(False)))
    has_cluster = F.col("cluster_id").isNotNull()
    action = (
        F.when(F.col("_escalates"), "escalate")
        .when(has_cluster & F.col("_open_before"), "route_to_existing")
        .when(F.col("_creates"), "create_ticket")
        .otherwise("auto_resolve")
    )
    department = F.when(F.col("_escalates"), "Executive_Escalations").otherwise(department_map(F.col("theme_primary"), F.col("intent"), social))
    marked = marked.withColumns({"routing_action": action, "_department": department})
    opened = F.when(F.col("routing_action").isin("escalate", "create_ticket"), F.struct(F.col("_new").alias("id"), F.col("_department").alias("department")))
    last = F.last(opened, ignorenulls=True).over(before)
    marked = marked.withColumns({"_last": last, "_row": F.row_number().over(order)})
    resolved = has_cluster & (F.coalesce("all_resolved", F.lit(False)) | ((F.col("_row") > 1) & ~F.col("_open_before")))
    resolution = (
        F.when(F.col("duplicate_count") > 0, "duplicate")
        .when((F.col("intent") == "praise") & (F.col("priority_level") == "low") & ~F.col("requires_action"), "no_action_required")
        .when(resolved, "known_resolved")
        .when((F.col("intent") == "request_for_help") & (F.col("priority_level") == "low") & F.col("theme_primary").isin(R.FAQ_TOPICS), "faq_matched")
        .otherwise("no_action_required")
    )
    a = F.col("routing_action")
    return marked.select(
        "feedback_id",
        "cluster_id",
        "routing_action",
        F.when(a != "route_to_existing", F.col("_new")).alias("new_ticket_id"),
        F.when(a == "route_to_existing", F.coalesce("_last.id", F.col("open_ticket_id").cast("string"))).alias("linked_ticket_id"),
        F.when(a == "auto_resolve", "Customer_Care").when(a == "route_to_existing", F.coalesce("_last.department", "open_department")).otherwise(F.col("_department")).alias("department"),
        F.when(a == "auto_resolve", resolution).alias("resolution_type"),
        "ts",
        F.when(a == "escalate", "critical").otherwise(F.col("priority_level")).alias("priority_level"),
    )


def leading_tickets(tickets: DataFrame) -> DataFrame:
    """A ticket for each cluster, by which ``cluster_ticket_state`` says what it says by all of
    ``tickets``: the open one that was updated last, of one time the one of the greatest
    ``opened_by``, or one that is closed."""
    names = ["updated_at", "opened_by", "ticket_id", "assigned_department", "ticket_phase"]
    best = F.max(F.struct(F.col("ticket_phase").isin(R.OPEN_PHASES).alias("_open"), *names)).alias("t")
    return tickets.where("linked_cluster_id is not null").groupBy("linked_cluster_id").agg(best).select("linked_cluster_id", *(f"t.{n}" for n in names))


def ticket_rows(routed: DataFrame, *more: Column) -> DataFrame:
    """The tickets that routed feedback opened."""
    return routed.where("new_ticket_id is not null").select(
        F.col("new_ticket_id").alias("ticket_id"),
        F.when(F.col("routing_action") == "auto_resolve", "auto_closed").otherwise("new").alias("ticket_phase"),
        "priority_level",
        F.col("department").alias("assigned_department"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        "resolution_type",
        F.col("cluster_id").alias("linked_cluster_id"),
        *more,
    )


def persist_star(routed: DataFrame, analysed: DataFrame) -> dict[str, DataFrame]:
    """Feedback, analysis, ticket and link rows of routed feedback."""
    linked = F.coalesce("new_ticket_id", "linked_ticket_id")
    return {
        "feedback": analysed.select("feedback_id", "source_type", "text", "ts"),
        "analysis": analysed.select("feedback_id", "priority_level", "theme_primary", "intent", "cluster_id", "requires_action"),
        "tickets": ticket_rows(routed),
        "links": routed.select("feedback_id", linked.alias("ticket_id")),
    }
