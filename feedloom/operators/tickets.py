"""Tickets, comments, phases, and the joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.sources.shared import write_and_read


def tickets_with_counts(tickets: DataFrame, feedback: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Tickets with the number of linked feedback (0 kept)."""
    if statuses:
        tickets = tickets.where(F.col("status").isin(statuses))
    counts = feedback.where("ticket_id is not null").groupBy("ticket_id").agg(F.count("*").alias("n_feedback"))
    return tickets.join(counts, "ticket_id", "left").withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0).cast("long")))


def ticket_detail(tickets: DataFrame, feedback: DataFrame) -> DataFrame:
    """Tickets with ids of linked feedback in order of time."""
    one = F.sort_array(F.collect_list(F.struct("created_at", "feedback_id")))
    linked = feedback.where("ticket_id is not null").groupBy("ticket_id").agg(F.transform(one, lambda x: x.feedback_id).alias("feedback_ids"))
    return tickets.join(linked, "ticket_id", "left").withColumn("feedback_ids", F.coalesce("feedback_ids", F.array().cast("array<long>")))


def status_view(feedback: DataFrame, tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """Feedback with its ticket's status and all comments in (time, id) order."""
    one = F.sort_array(F.collect_list(F.struct("created_at", "comment_id", "text")))
    said = comments.groupBy("ticket_id").agg(one.alias("comments"))
    state = tickets.select("ticket_id", F.col("status").alias("ticket_status")).join(said, "ticket_id", "left")
    return feedback.join(state, "ticket_id", "left").withColumn("analysis_in_progress", F.col("enrichment_status") == "pending")


def submission_history(submissions: DataFrame, transitions: DataFrame) -> DataFrame:
    one = F.sort_array(F.collect_list(F.struct("timestamp", "id", "previous_state", "new_state")))
    steps = transitions.groupBy("submission_id").agg(one.alias("history"))
    return submissions.join(steps, "submission_id", "left")


def review_queue(queue: DataFrame, submissions: DataFrame) -> DataFrame:
    """Queued submissions with a summary of their enrichment, oldest first."""
    v = F.try_parse_json("enrichment_result")
    return queue.join(submissions, "submission_id").select(
        "submission_id",
        "queued_at",
        F.try_variant_get(v, "$.themes[0].theme", "string").alias("theme"),
        F.try_variant_get(v, "$.severity_score", "int").alias("severity_score"),
    )


def cluster_all_resolved(tickets: DataFrame) -> DataFrame:
    open_ = F.count_if(F.col("ticket_phase").isin(R.OPEN_PHASES))
    return tickets.where("linked_cluster_id is not null").groupBy("linked_cluster_id").agg((open_ == 0).alias("all_resolved"))


def latest_open_ticket_per_cluster(tickets: DataFrame) -> DataFrame:
    one = F.struct("updated_at", "ticket_id")
    open_ = tickets.where(F.col("ticket_phase").isin(R.OPEN_PHASES) & F.col("linked_cluster_id").isNotNull())
    return open_.groupBy("linked_cluster_id").agg(F.max(one).alias("t")).select("linked_cluster_id", F.col("t.ticket_id").alias("ticket_id"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``.  Those without a key stay and are no part of the join, which
    would deal them all to one task.  A task holds its ids of ``gone`` and sorts no rows."""
    return rows.where(F.col(key).isNotNull()).join(gone.hint("shuffle_hash"), key, "left_anti").unionByName(rows.where(F.col(key).isNull()))


def cascade_delete(tickets: DataFrame, comments: DataFrame, feedback: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """What is left after removing the tickets of ``doomed(feedback_id)`` with their comments and
    all feedback linked to them; feedback without a ticket goes alone.  Counts come along."""
    picked = write_and_read(feedback.select("feedback_id", "ticket_id").join(doomed.hint("shuffle_hash"), "feedback_id", "left_semi"), "picked")
    gone = picked.where("ticket_id is not null").select("ticket_id").distinct()
    alone = picked.where("ticket_id is null").select("feedback_id")
    left = {
        "tickets": without(tickets, gone, "ticket_id"),
        "comments": without(comments, gone, "ticket_id"),
        "feedback": without(without(feedback, gone, "ticket_id"), alone, "feedback_id"),
    }
    counts = None
    for name, whole in (("tickets", tickets), ("comments", comments), ("feedback", feedback)):
        n = whole.agg(F.count("*").alias("before")).crossJoin(left[name].agg(F.count("*").alias("after")))  # one row each
        n = n.select(F.lit(name).alias("table_name"), (F.col("before") - F.col("after")).alias("removed"))
        counts = n if counts is None else counts.unionByName(n)
    return left | {"counts": counts}


def link_integrity(requests: DataFrame, tickets: DataFrame, feedback: DataFrame, links: DataFrame) -> DataFrame:
    """Requests (feedback_id, ticket_id) with ``error``: unknown ticket, unknown feedback, or
    feedback that is already linked."""
    marks = [(tickets.select("ticket_id").distinct(), "ticket_id", "_t"), (feedback.select("feedback_id").distinct(), "feedback_id", "_f"), (links.select("feedback_id").distinct(), "feedback_id", "_l")]
    out = requests
    for table, key, name in marks:
        out = out.join(table.withColumn(name, F.lit(True)), key, "left")
    error = F.when(F.col("_t").isNull(), "unknown_ticket").when(F.col("_f").isNull(), "unknown_feedback").when(F.col("_l"), "already_linked")
    return out.withColumn("error", error).drop("_t", "_f", "_l")


def _allowed(phase: Column) -> Column:
    moves = F.create_map(*(x for k, v in R.NEXT_PHASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return F.coalesce(F.element_at(moves, phase), F.array().cast("array<string>"))


def ticket_phase_transition(tickets: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(ticket_id, seq, new_phase, resolution_type, actor)`` applied in order; an audit
    row for each: previous phase, new phase, error, valid phases.

    A request that breaks the matrix or resolves without a resolution type leaves the phase.  The
    fold stays inside a ticket's own requests.
    """
    one = F.sort_array(F.collect_list(F.struct("seq", "new_phase", "resolution_type", "actor")))
    asked = requests.groupBy("ticket_id").agg(one.alias("asked")).join(tickets.select("ticket_id", "ticket_phase"), "ticket_id")
    audit = "array<struct<seq:bigint,previous_phase:string,new_phase:string,phase_after:string,error:string,actor:string>>"

    def step(done, r):
        now = F.coalesce(F.element_at(done, -1).phase_after, F.col("ticket_phase"))
        now = F.when(F.size(done) == 0, F.col("ticket_phase")).otherwise(now)
        error = F.when(~F.array_contains(_allowed(now), r.new_phase), "invalid_transition").when(
            (r.new_phase == "resolved") & ~F.coalesce(r.resolution_type.isin(R.RESOLUTIONS), F.lit(False)), "resolution_type_required"
        )
        row = F.struct(
            r.seq.cast("bigint").alias("seq"),
            now.alias("previous_phase"),
            r.new_phase.alias("new_phase"),
            F.when(error.isNull(), r.new_phase).otherwise(now).alias("phase_after"),
            error.alias("error"),
            F.substring(r.actor, 1, 150).alias("actor"),
        )
        return F.concat(done, F.array(row))

    rows = asked.select("ticket_id", F.inline(F.aggregate("asked", F.array().cast(audit), step)))
    return rows.withColumn("valid_phases", F.when(F.col("error") == "invalid_transition", F.array_join(_allowed(F.col("previous_phase")), ",")))


def ticket_status_advance(tickets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with ``error``, comments for customers of those that pass)."""
    follows = F.create_map(*map(F.lit, ["open", "in_progress", "in_progress", "resolved"]))
    joined = requests.join(tickets.select("ticket_id", "status"), "ticket_id", "left")
    error = F.when(F.col("status").isNull(), "unknown_ticket").when(
        ~F.coalesce(F.element_at(follows, F.col("status")) == F.col("new_status"), F.lit(False)), "invalid_transition"
    )
    checked = joined.withColumn("error", error)
    text = F.when(F.col("new_status") == "in_progress", "We have started working on your ticket.").otherwise("Your ticket has been resolved.")
    return checked, checked.where("error is null").select("ticket_id", text.alias("text"), "requested_at")


def comment_add(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Comment requests with ``error``: blank text or unknown ticket."""
    from feedloom.functions.text import strip_space

    known = tickets.select("ticket_id").distinct().withColumn("_known", F.lit(True))
    blank = F.coalesce(strip_space(F.col("text")), F.lit("")) == ""
    return requests.join(known, "ticket_id", "left").withColumn("error", F.when(blank, "blank_text").when(F.col("_known").isNull(), "unknown_ticket")).drop("_known")


def progress_transition(events: DataFrame, initial: Column) -> DataFrame:
    """History rows of ``events(submission_id, seq, new_state, ts)``: each with the state before."""
    order = Window.partitionBy("submission_id").orderBy("seq")
    return events.withColumn("previous_state", F.coalesce(F.lag("new_state").over(order), initial))


def migrate_legacy(legacy_tickets: DataFrame, submissions: DataFrame, queue: DataFrame, tickets: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """Legacy rows in the new tables; rows that exist stay, missing links are repaired; running
    it again changes nothing.  ``report`` counts what was read and written."""
    as_ticket = legacy_tickets.select("ticket_id", F.col("issue_category").alias("category"), "description", "priority", "status", "created_at")
    new_tickets = as_ticket.join(tickets.select("ticket_id"), "ticket_id", "left_anti")
    link = legacy_tickets.groupBy("submission_id").agg(F.min("ticket_id").alias("ticket_id"))
    queued = queue.select("submission_id").distinct().withColumn("_queued", F.lit(True))
    marked = submissions.join(link, "submission_id", "left").join(queued, "submission_id", "left")
    outcome = F.when(F.col("_queued"), "review").when(F.col("ticket_id").isNotNull(), "action_required").otherwise("review")
    as_feedback = marked.select(
        F.col("submission_id").alias("feedback_id"),
        "text",
        "created_at",
        "sentiment",
        outcome.alias("triage_outcome"),
        (outcome == "review").alias("needs_review"),
        "ticket_id",
    )
    new_feedback = as_feedback.join(feedback.select("feedback_id"), "feedback_id", "left_anti")
    repair = link.withColumnRenamed("ticket_id", "_link").withColumnRenamed("submission_id", "feedback_id")
    kept = feedback.join(repair, "feedback_id", "left").withColumn("ticket_id", F.coalesce("ticket_id", "_link")).drop("_link")
    report = None
    for name, read, written in (("tickets", legacy_tickets, new_tickets), ("feedback", submissions, new_feedback)):
        one = read.agg(F.count("*").alias("read")).crossJoin(written.agg(F.count("*").alias("written"))).withColumn("table_name", F.lit(name))  # one row each
        report = one if report is None else report.unionByName(one)
    return {"tickets": tickets.unionByName(new_tickets), "feedback": kept.unionByName(new_feedback), "report": report}


def marketing_log(submissions: DataFrame, base_url: str) -> DataFrame:
    """Positive submissions: sharing status, link and the text without personal data."""
    from feedloom.functions.text import strip_pii_for_sharing

    shared = F.coalesce("social_sharing", F.lit(False))
    return submissions.where("sentiment = 'positive'").select(
        "submission_id",
        "customer_name",
        F.when(shared, "shared").otherwise("internal_only").alias("social_status"),
        F.when(shared, F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("submission_id").cast("string"))).alias("shareable_url"),
        F.when(shared, strip_pii_for_sharing(F.col("praise_text"), F.col("customer_name"))).alias("share_text"),
    )
