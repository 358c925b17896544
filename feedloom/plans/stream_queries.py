"""The streaming twins, fed from the given tables as file streams until all input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import triage as G
from feedloom.plans.registry import query
from feedloom.plans.routing_queries import ROUTE, to_route
from feedloom.plans.views import VIEWS
from feedloom.sources import tables
from feedloom.sources.shared import new_path
from feedloom.streaming import streams as S
from feedloom.streaming.lifecycle import stream_lifecycle


PARTS = 6


def events_stream(v) -> DataFrame:
    schema = v.events.schema
    # a pattern, since the table may be one file, which a stream does not take as its folder
    return v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/events.parque[t]")


def events_in_order(v) -> DataFrame:
    """All events as a stream of several triggers: parts by time, written one after the other, a
    trigger takes the files of one at a time."""
    path, events = new_path(v.spark, "events"), v.events
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [k / PARTS for k in range(1, PARTS)], 0.001)
    part = sum((F.when(F.unix_micros(F.col("ts").cast("timestamp")) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(PARTS):
        events.where(part == k).write.mode("append").parquet(path)
    files = v.spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    return v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // PARTS)).parquet(path)


def feedback_stream(v, in_order: bool = False) -> DataFrame:
    events = events_in_order(v) if in_order else events_stream(v)
    return v.spark.sql(VIEWS["fb"].replace("from events", "from {events}"), events=events)


class Kept:
    """A sink for batches: each epoch overwrites its own folder."""

    def __init__(self, v, name: str):
        self.spark, self.path, self.schema, self.epochs = v.spark, new_path(v.spark, name), None, 0

    def __call__(self, part: DataFrame, epoch: int) -> None:
        self.schema, self.epochs = part.schema, self.epochs + 1
        part.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def rows(self) -> DataFrame:
        if self.epochs < 2:
            raise RuntimeError("the stream was to come in several triggers")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch=*")


def drained(v, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that the stream gives; in complete mode those of the last trigger."""
    path, schema = new_path(v.spark, name), df.schema

    def keep(part: DataFrame, epoch: int) -> None:
        if mode == "complete":
            part.write.mode("overwrite").parquet(f"{path}/all")
        else:
            part.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    v.spark.createDataFrame([], schema).write.parquet(f"{path}/all" if mode == "complete" else f"{path}/epoch=-1")
    done = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    done.awaitTermination()
    return v.spark.read.schema(schema).parquet(f"{path}/all" if mode == "complete" else f"{path}/epoch=*")


@query("stream_ingest", """select case event_id % 5 when 0 then 'email' when 1 then 'survey' when 2 then 'call_transcript' when 3 then 'social_post' end as source_channel, count(*) as n
from events where event_id % 5 < 4 group by 1""")
def _(v):
    channels = F.array(*map(F.lit, ["email", "survey", "call_transcript", "social_post", "fax"]))
    raw = events_stream(v).select(F.get(channels, F.col("event_id") % 5).alias("source_channel"), F.col("props").alias("text"))
    path = new_path(v.spark, "stream-ingest")
    keep = lambda kind: lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/{kind}/epoch={epoch}")
    S.stream_ingest(raw, keep("good"), keep("bad"), f"{path}/state").awaitTermination()
    return v.spark.read.parquet(f"{path}/good/epoch=*").groupBy("source_channel").agg(F.count("*").alias("n"))


@query("stream_dedup", """
with recursive k as (select source_type, lower(text) as t, created_at, feedback_id, row_number() over (partition by source_type, lower(text) order by created_at, feedback_id) as r from fb),
f as (select source_type, t, r, feedback_id, feedback_id as original_id, created_at as a from k where r = 1
 union all select k.source_type, k.t, k.r, k.feedback_id, case when k.created_at - f.a <= interval 24 hour then f.original_id else k.feedback_id end, case when k.created_at - f.a <= interval 24 hour then f.a else k.created_at end
 from f join k on k.source_type = f.source_type and k.t = f.t and k.r = f.r + 1)
select feedback_id, original_id, feedback_id = original_id as is_original from f""")
def _(v):
    rows = feedback_stream(v, in_order=True).select("source_type", F.col("text").alias("masked_text"), F.col("created_at").alias("ts"), "feedback_id")
    kept = Kept(v, "stream-dedup")
    S.stream_dedup(rows, kept, new_path(v.spark, "dedup-state")).awaitTermination()
    return kept.rows().select("feedback_id", "original_id", "is_original")


@query("stream_theme_counts", """select cast(created_at as date) as day, theme, count(*) as n from fb
where cast(created_at as date) + interval 1 day <= (select max(created_at) from fb) - interval 1 day group by 1, 2""")
def _(v):
    # the days that the watermark, a day behind the latest record, has closed
    rows = feedback_stream(v, in_order=True).select("theme", F.col("created_at").alias("ts"))
    return drained(v, S.stream_theme_counts(rows), "stream-themes")


@query("stream_clusters")
def _(v):
    rows = feedback_stream(v, in_order=True).select("feedback_id", "theme", F.col("created_at").alias("ts"), "text", "latitude", "longitude")
    kept = Kept(v, "stream-clusters")
    S.stream_clusters(rows, kept, new_path(v.spark, "cluster-state")).awaitTermination()
    return kept.rows()


@query("stream_lifecycle", """with g as (select customer_id as cluster_id, created_at as t, coalesce(lead(created_at) over (partition by customer_id order by created_at), (select max(created_at) - interval 1 hour from fb)) as next from fb)
select cluster_id, 'active' as status, min(t) as at from g group by 1 union all select cluster_id, 'monitoring', min(t) + interval 1 day from g where next - t > interval 1 day group by 1
union all select cluster_id, 'resolved', min(t) + interval 2 day from g where next - t > interval 2 day group by 1""")
def _(v):
    # a customer's feedback is a cluster, with steps after one and two idle days, of which there are some
    rows = feedback_stream(v, in_order=True).select(F.col("customer_id").alias("cluster_id"), F.col("created_at").alias("ts"))
    return drained(v, stream_lifecycle(rows, 1, 2), "stream-lifecycle")


@query("stream_routing", ROUTE + """
select feedback_id, act as routing_action, case when act = 'route_to_existing' then seen end as linked_ticket_id,
 case when act <> 'auto_resolve' then null when intent = 'praise' and priority_level = 'low' and not action then 'no_action_required' when has_cluster and (all_done or r > 1) and seen is null then 'known_resolved'
  when intent = 'request_for_help' and priority_level = 'low' and theme in ('billing', 'installation', 'app_usability', 'support_experience') then 'faq_matched' else 'no_action_required' end as resolution_type from w""")
def _(v):
    kept = Kept(v, "stream-routing")
    S.stream_routing(to_route(feedback_stream(v, in_order=True)), v.rt, v.rl, v.fb, kept, new_path(v.spark, "ticket-state")).awaitTermination()
    return kept.rows().select("feedback_id", "routing_action", "linked_ticket_id", "resolution_type")


def enrich_status(v, delay: str = "5") -> DataFrame:
    """Status of each record when its answer comes ``delay`` seconds later and a quarter has none.
    Both sources end with a row an hour later, which closes what is open."""
    path = new_path(v.spark, "ends")
    feedback = v.fb.select("feedback_id", F.col("created_at").alias("ts"))
    answers = v.fb.where("feedback_id % 4 <> 0").select(
        "feedback_id", (F.col("created_at") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {delay})")).alias("response_ts"), (F.col("feedback_id") % 3 == 0).alias("ok")
    )
    streams = []
    for name, rows, ts, none in (("feedback", feedback, "ts", -1), ("answers", answers, "response_ts", -2)):
        end = rows.agg(F.lit(none).cast("long").alias("feedback_id"), (F.max(ts) + F.expr("interval 1 hour")).alias(ts))
        rows.unionByName(end, allowMissingColumns=True).write.parquet(f"{path}/{name}")
        streams.append(v.spark.readStream.schema(rows.schema).parquet(f"{path}/{name}"))
    return drained(v, S.stream_enrich_status(*streams), "stream-status")


@query("stream_enrich_status", "select feedback_id, case when feedback_id % 4 = 0 or feedback_id % 60 > 30 then 'timeout' when feedback_id % 3 = 0 then 'completed' else 'failed' end as enrichment_status from fb")
def _(v):
    return enrich_status(v, "feedback_id % 60")


@query("stream_enrich_status_all", "select feedback_id, case when feedback_id % 4 = 0 then 'timeout' when feedback_id % 3 = 0 then 'completed' else 'failed' end as enrichment_status from fb")
def _(v):
    return enrich_status(v)


@query("save_batch", "select batch_id, count(*) as n from fb group by 1")
def _(v):
    path = new_path(v.spark, "batches")
    tables.save_batch(v.fb, path)
    return v.spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("get_batch", "select feedback_id from fb where batch_id = 'b3'")
def _(v):
    path = new_path(v.spark, "batches")
    tables.save_batch(v.fb.select("feedback_id", "batch_id"), path)
    return tables.get_batch(v.spark, path, "b3").select("feedback_id")


@query("generate_fn", "select feedback_id, '{\"n\":' || length(text) || '}' as raw_json from fb where text <> ''")
def _(v):
    from feedloom.functions.hooks import generate_fn

    asked = v.fb.where("text <> ''").select("feedback_id", F.lit("count").alias("stage"), F.col("text").alias("prompt"))
    return generate_fn(asked, lambda prompt: '{"n":%d}' % len(prompt)).select("feedback_id", "raw_json")


@query("embedding_fn", "select item_id, length(text)::float as size from benchmark")
def _(v):
    from feedloom.functions.hooks import embedding_fn

    embed = embedding_fn(lambda texts: [[float(len(t)), 1.0] for t in texts])
    return v.benchmark.select("item_id", F.get(embed("text"), F.lit(0)).alias("size"))


@query("validate_windows", "select count(*) as n from fb where created_at < timestamp '2024-01-30'")
def _(v):
    from feedloom.operators.trends import Windows, in_windows

    w = Windows.parse("2024-01-01T00:00:00Z", "2024-01-15T00:00:00Z", "2024-01-15T00:00:00Z", "2024-01-30T00:00:00Z")
    return in_windows(v.fb, "created_at", w).agg(F.count("*").alias("n"))


@query("rule_parameters", "select feedback_id, theme_confidence < 0.6 or sentiment_confidence < 0.6 as flag from fb")
def _(v):
    from feedloom.params import RuleParameters

    p = RuleParameters(review_threshold=0.6)
    themes = F.array(F.struct(F.col("theme_confidence").alias("confidence")))
    return v.fb.select("feedback_id", G.needs_review(F.col("sentiment_confidence"), themes, p.review_threshold).alias("flag"))
