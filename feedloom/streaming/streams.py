"""Structured Streaming twins of the operators that keep state between records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.clusters import fold_onto
from feedloom.operators.ingest import ingest_batch
from feedloom.operators.ordered import first_after, in_parts, last_until, orbits, sum_before
from feedloom.operators.triage import customer_open_tickets, leading_tickets, routing_decision, ticket_rows
from feedloom.sources.shared import write_and_read
from feedloom.sources.versions import Versions

DAY_US = 86_400_000_000


def stream_ingest(raw: DataFrame, good: Callable[[DataFrame, int], None], rejects: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Validates each micro-batch once and hands good and rejected rows to their sinks."""

    def each(df: DataFrame, epoch: int) -> None:
        checked = ingest_batch(df).persist()  # two sinks read it
        try:
            good(checked.where("reject_reason is null").drop("reject_reason"), epoch)
            rejects(checked.where("reject_reason is not null"), epoch)
        finally:
            checked.unpersist()

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ANCHORS = "source_type string, text_key string, t long, feedback_id long, n long"


def dedup_step(rows: DataFrame, anchors: DataFrame, window_us: int = DAY_US) -> tuple[DataFrame, DataFrame]:
    """One batch ``rows(source_type, masked_text, ts, feedback_id)`` against the keys' last
    originals: the batch's rows as (source_type, feedback_id, original_id, is_original,
    duplicate_count), and the anchors of its keys afterwards.

    The steps are those of the batch operator over range-sorted parts, so a key with any share of a
    batch is dealt over all tasks.  Rows earlier than their key's anchor, which come late, are its
    duplicates within the window, else originals that leave it where it is; they raise no count.
    """
    key = F.struct("source_type", "text_key")
    new = rows.where("ts is not null").select("source_type", F.coalesce(F.md5(F.lower("masked_text")), F.lit("")).alias("text_key"), F.unix_micros("ts").alias("t"), "feedback_id")
    new = new.withColumn("source_type", F.coalesce("source_type", F.lit("")))
    touched = anchors.join(new.select("source_type", "text_key").distinct(), ["source_type", "text_key"], "left_semi")
    old = touched.select(key.alias("key"), F.col("t").alias("anchor_t"), F.col("feedback_id").alias("anchor_id"), F.col("n").alias("anchor_n"))
    marks = new.select(key.alias("key"), "t", F.lit(1).alias("kind"), "feedback_id").union(old.select("key", "anchor_t", F.lit(0), "anchor_id"))
    parts = in_parts(marks, "key", "t", "kind", "feedback_id")
    placed = write_and_read(sum_before(parts, F.col("kind")).join(old, "key", "left"), "placed")
    on_time = placed.where("anchor_t is null or kind = 0 or t >= anchor_t")
    roots = on_time.groupBy("key").agg(F.min("_at").alias("at"))
    marked = orbits(roots, first_after(on_time.select("key", "t", F.col("_at").alias("at")), F.col("t") + window_us))
    flagged = write_and_read(placed.join(marked.withColumn("_original", F.lit(True)), placed["_at"] == marked["at"], "left").drop("at"), "flagged")
    late = F.col("t") < F.col("anchor_t")
    known = F.when(F.col("kind") == 0, F.col("anchor_n") - F.col("before")).otherwise(-F.col("before") - 1)  # counts from here on
    original = F.when(F.coalesce("_original", F.lit(False)), F.struct("key", "feedback_id", "t", known.alias("from")))
    got = write_and_read(last_until(flagged, original), "originals")
    near = F.col("anchor_t") - F.col("t") <= window_us
    out = got.where("kind = 1").select(
        "key.source_type",
        "feedback_id",
        F.when(late, F.when(near, F.col("anchor_id")).otherwise(F.col("feedback_id"))).otherwise(F.col("last.feedback_id")).alias("original_id"),
        F.when(late, ~near).otherwise(F.coalesce("_original", F.lit(False))).alias("is_original"),
        F.when(late, F.when(near, F.col("anchor_n")).otherwise(0)).otherwise(F.col("last.from") + F.col("before") + 1).alias("duplicate_count"),
    )
    ends = got.where("kind = 0 or not coalesce(t < anchor_t, false)").groupBy("key").agg(F.max_by(F.struct("last", (F.col("last.from") + F.col("before") + F.col("kind")).alias("n")), "_at").alias("e"))
    after = ends.select("key.source_type", "key.text_key", F.col("e.last.t").alias("t"), F.col("e.last.feedback_id").alias("feedback_id"), F.col("e.n").alias("n"))
    return out, after


def stream_dedup(rows: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, window_us: int = DAY_US, late_us: int = DAY_US) -> StreamingQuery:
    """``rows(source_type, masked_text, ts, feedback_id)``: ``sink`` gets a row per record, original
    or not, and the original's running ``duplicate_count``.

    Between batches the last original of each key lies in a versioned table in ``folder``.  Those
    that no record within ``late_us`` of the latest time can meet are taken out with the next batch
    that touches the folder; a replayed batch gives and leaves what it did.
    """
    state = Versions(rows.sparkSession, f"{folder}/anchors", ANCHORS, ["source_type", "text_key"])

    def each(batch: DataFrame, epoch: int) -> None:
        before = state.before(epoch)
        out, after = dedup_step(batch, before, window_us)
        sink(out, epoch)
        latest = batch.agg(F.max(F.unix_micros("ts")).alias("_latest"))
        old = F.col("t") < F.col("_latest") - late_us - window_us
        rest = before.join(after.select("source_type", "text_key"), ["source_type", "text_key"], "left_anti").crossJoin(F.broadcast(latest)).where(old)  # one row
        gone = rest.select(*after.columns, F.lit(True).alias("gone"))
        state.write(after.withColumn("gone", F.lit(False)).unionByName(gone), epoch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def stream_theme_counts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily counts per theme; in append mode a day comes once, when the watermark has passed it."""
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "theme").agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "theme", "n")


def stream_late_rows(rows: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, late: str = "1 day") -> StreamingQuery:
    """``sink`` gets the rows (with a column ``ts``) whose day ``stream_theme_counts`` had closed when
    they came, which it leaves out: by the latest time of the batches before."""
    state = Versions(rows.sparkSession, f"{folder}/latest", "name string, ts timestamp", ["name"])

    def each(batch: DataFrame, epoch: int) -> None:
        before = state.before(epoch).agg(F.max("ts").alias("_latest"))
        ends = F.date_trunc("day", "ts") + F.expr("interval 1 day")
        sink(batch.crossJoin(F.broadcast(before)).where(ends <= F.col("_latest") - F.expr(f"interval {late}")).drop("_latest"), epoch)  # one row
        seen = batch.select("ts").union(before).agg(F.max("ts").alias("ts"))
        state.write(seen.select(F.lit("all").alias("name"), "ts"), epoch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


CLUSTERS = "cluster_id string, theme string, born long, vector array<struct<bucket: int, n: double>>, latitude double, longitude double, volume long, summarised long, seen long"


def stream_clusters(rows: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, resolved_days: int = 21) -> StreamingQuery:
    """``rows(feedback_id, theme, ts, text, latitude, longitude)``: ``sink`` gets (feedback_id,
    theme, cluster_id) of each record.

    A batch is sorted by theme, part, time and id in Spark and streams through the clusters that its
    records may join, those that earlier batches left first.  A cluster is a row of a versioned table
    in ``folder`` and is written when it changed; one that was idle for ``resolved_days`` takes no
    record any more and goes.  In order of time the result is that of the batch operator, however the
    stream is cut; a replayed batch gives and leaves what it did.
    """
    state = Versions(rows.sparkSession, f"{folder}/clusters", CLUSTERS, ["cluster_id"])

    def each(batch: DataFrame, epoch: int) -> None:
        placed, changed = fold_onto(write_and_read(batch, "batch"), write_and_read(state.before(epoch), "known-clusters"), resolved_days)
        sink(placed, epoch)
        state.write(changed, epoch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


TICKETS = "ticket_id string, ticket_phase string, assigned_department string, updated_at timestamp, opened_by long, linked_cluster_id long"


def given_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.col("ticket_id").cast("string"), "ticket_phase", "assigned_department", "updated_at", F.col("ticket_id").cast("long").alias("opened_by"), "linked_cluster_id")


def known_tickets(tickets: DataFrame, state: Versions, epoch: int) -> DataFrame:
    """The given tickets and those that epochs before this one opened."""
    return given_tickets(tickets).unionByName(state.before(epoch))


def opened_tickets(routed: DataFrame, rows: DataFrame) -> DataFrame:
    return ticket_rows(routed, F.col("feedback_id").alias("opened_by"))


def stream_routing(rows: DataFrame, tickets: DataFrame, links: DataFrame, linked: DataFrame, sink: Callable[[DataFrame, int], None], folder: str) -> StreamingQuery:
    """Decides each micro-batch against ``tickets`` and those that earlier batches opened; ``sink``
    gets ``routing_decision``'s rows.

    ``rows`` is as ``routing_decision`` takes it.  Opened tickets lie in a versioned table in
    ``folder``, and one for each cluster, the leading one, in another: an epoch reads only the
    leading ones that earlier ones wrote and overwrites its own versions, so a replay changes
    nothing.  ``links`` and the feedback ``linked`` of customers' open tickets are those of
    the start, as in the batch operator.
    """
    state = Versions(rows.sparkSession, f"{folder}/tickets", TICKETS, ["ticket_id"])
    leaders = Versions(rows.sparkSession, f"{folder}/leading", TICKETS, ["linked_cluster_id"])
    given = write_and_read(leading_tickets(given_tickets(tickets)), "given-tickets")
    open_links = write_and_read(customer_open_tickets(tickets, links, linked), "open-links")

    def each(batch: DataFrame, epoch: int) -> None:
        known = write_and_read(leading_tickets(given.unionByName(leaders.before(epoch))), "leading")
        routed = write_and_read(routing_decision(batch, known, open_links=open_links), "routed")
        sink(routed, epoch)
        opened = opened_tickets(routed, batch).select(known.columns)
        state.write(opened, epoch)
        leaders.write(leading_tickets(known.join(opened, "linked_cluster_id", "left_semi").unionByName(opened)), epoch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def stream_enrich_status(feedback: DataFrame, responses: DataFrame, limit: str = "30 seconds") -> DataFrame:
    """``feedback(feedback_id, ts)`` and ``responses(feedback_id, response_ts, ok)`` -> status of
    each record: completed, failed, or timeout when no answer came in time.

    A record's timeout comes with the watermark, so a source that ends must end with a later row on
    both sides, of an id that no record has: it moves the watermark and stays open itself.
    """
    left = feedback.withWatermark("ts", "1 minute").alias("f")
    right = responses.withWatermark("response_ts", "1 minute").withColumnRenamed("feedback_id", "response_id").alias("r")
    on = F.expr(f"response_id = feedback_id and response_ts >= ts and response_ts <= ts + interval {limit}")
    joined = left.join(right, on, "leftOuter")
    status = F.when(F.col("response_id").isNull(), "timeout").when(F.col("ok"), "completed").otherwise("failed")
    return joined.select("feedback_id", status.alias("enrichment_status"))
