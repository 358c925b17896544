"""Small lookups and labels for screens and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import rules as R


def severity_to_ten(score: Column) -> Column:
    ten = F.least(F.lit(10), F.greatest(F.lit(1), F.bround(score * 2))).cast("int")
    return F.when(score.isNotNull(), ten)


def keyword_department(label: Column) -> Column:
    """Department of the first keyword in a theme's label, or null."""
    out = F.lit(None).cast("string")
    for word, department in reversed(R.KEYWORD_DEPARTMENT):
        out = F.when(F.lower(label).contains(word), department).otherwise(out)
    return out


def department_for_themes(labels: Column) -> Column:
    """Department of the first theme that names one."""
    known = F.filter(F.transform(labels, keyword_department), lambda d: d.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(R.DEFAULT_DEPARTMENT))


def theme_label(theme: Column, name: Column, label: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(theme, blank), F.nullif(name, blank), F.nullif(label, blank))


def issue_category(labels: Column) -> Column:
    return F.coalesce(F.get(labels, F.lit(0)), F.lit("general"))


def initial_progress(sentiment: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in R.INITIAL_PROGRESS.items() for x in kv)), sentiment)


def status_message(progress: Column, sentiment: Column, provider: str = "Our team", unknown: str = "Awaiting Review") -> Column:
    done = F.when(sentiment == "positive", "Praise received & noted!").otherwise("Your issue has been resolved.")
    return (
        F.when(progress == 100, done)
        .when(progress == 25, "Awaiting Review")
        .when(progress == 50, f"{provider} is working on this.")
        .when(progress == 75, "Almost there — resolution in progress.")
        .otherwise(unknown)
    )


def source_display(source_type: Column, platform: Column, channel: Column) -> tuple[Column, Column]:
    social = source_type == "social"
    return F.when(social, "Social").otherwise("Direct"), F.coalesce(F.when(social, platform).otherwise(channel), F.lit(""))


def source_key(source_type: Column, platform: Column) -> Column:
    return F.when((source_type == "social") & (F.length(platform) > 0), platform).otherwise("direct")


def source_label(key: Column) -> Column:
    return F.concat(F.upper(F.substring(key, 1, 1)), key.substr(F.lit(2), F.length(key)))


def bands(value: Column, limits: list[tuple[float, str]], other: str, missing: str | None = None) -> Column:
    """The name of the first limit that the value reaches."""
    out = F.when(value.isNull(), F.lit(missing))
    for limit, name in limits:
        out = out.when(value >= limit, name)
    return out.otherwise(other)


def severity_chip(value: Column) -> Column:
    return bands(value, [(8, "critical"), (6, "high"), (4, "medium")], "low")


def severity_chart(value: Column) -> Column:
    return bands(value, [(9, "critical"), (7, "high"), (4, "medium")], "low", "neutral")


def choropleth_band(count: Column, most: Column) -> Column:
    """5 for more than 0.8 of the most, down to 1; 0 for none."""
    share = count / most
    return F.when((count <= 0) | (most <= 0), 0).when(share > 0.8, 5).when(share > 0.6, 4).when(share > 0.4, 3).when(share > 0.2, 2).otherwise(1)


def status_label(enrichment_status: Column, has_ticket: Column) -> Column:
    return (
        F.when(enrichment_status == "pending", "We're reviewing your feedback")
        .when(enrichment_status.isin("failed", "timeout"), "We've received your feedback")
        .when(has_ticket, "A ticket has been opened for your feedback")
        .otherwise("Your feedback has been reviewed")
    )


def triage_label(outcome: Column) -> Column:
    return F.when(outcome == "action_required", "Action required — we are handling this as a ticket.").when(outcome == "no_action", "Reviewed and retained as feedback.")


def status_steps(triage_outcome: Column, ticket_status: Column) -> Column:
    """Ordered steps (label, state) of a feedback's progress."""

    def step(label: str, state: Column | str) -> Column:
        return F.struct(F.lit(label).alias("label"), (F.lit(state) if isinstance(state, str) else state).alias("state"))

    started = ticket_status.isin("in_progress", "resolved")
    always = F.array(step("Submitted", "done"), step("Reviewed", F.when(triage_outcome.isNotNull(), "done").otherwise("active")))
    ticket = F.array(
        step("Ticket opened", "done"),
        step("In progress", F.when(started, "done").otherwise("active")),
        step("Resolved", F.when(ticket_status == "resolved", "done").when(ticket_status == "in_progress", "active").otherwise("upcoming")),
    )
    kept = F.array(step("Logged as feedback", "done"))
    none = F.slice(kept, 1, 0)
    return F.concat(always, F.when(ticket_status.isNotNull(), ticket).when(triage_outcome == "no_action", kept).otherwise(none))
