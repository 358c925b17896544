"""Dashboard aggregates over the unified feedback table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.display import choropleth_band, source_key



def counts_by_sentiment_triage(rows: DataFrame) -> DataFrame:
    """Counts per sentiment, per triage outcome and in all, from one scan."""
    marked = rows.select(
        F.coalesce("sentiment", F.lit("unknown")).alias("sentiment"), F.coalesce("triage_outcome", F.lit("unclassified")).alias("triage_outcome")
    )
    sets = marked.groupingSets([[F.col("sentiment")], [F.col("triage_outcome")], []], F.col("sentiment"), F.col("triage_outcome"))
    counted = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 1, "sentiment").when(F.col("g") == 2, "triage_outcome").otherwise("total")
    return counted.select(kind.alias("kind"), F.coalesce("sentiment", "triage_outcome", F.lit("all")).alias("value"), "n")


def dashboard_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ticket_id").isNotNull()).alias("linked_tickets"),
        F.count_if(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
    )


def by_department(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("department") > 0).groupBy("department").agg(F.count("*").alias("n"))


def by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy(source_key(F.col("source_type"), F.col("platform")).alias("source")).agg(F.count("*").alias("n"))


def by_state(rows: DataFrame) -> DataFrame:
    """Count and mean severity per state; raw means, rounded where they are shown."""
    return rows.where("location_state is not null").groupBy("location_state").agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"))


def severity_distribution(rows: DataFrame) -> DataFrame:
    spine = rows.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("severity"))
    counts = rows.where(F.col("severity").between(1, 10)).groupBy("severity").agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # ten rows


def average_severity(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("severity").between(1, 10)).agg(F.avg("severity").alias("mean_severity"))


def daily_series(rows: DataFrame, last_day: Column, days: int = 30) -> DataFrame:
    """The last ``days`` days with totals and sentiments, days without feedback as zeros."""
    first = F.date_sub(last_day, days - 1)
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last_day)).alias("day"))
    day = F.to_date("created_at")
    parts = [F.count_if(F.col("sentiment") == s).alias(s) for s in ("negative", "neutral", "positive")]
    counts = rows.where(day.between(first, last_day)).groupBy(day.alias("day")).agg(F.count("*").alias("total"), *parts)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "negative", "neutral", "positive")]
    return spine.join(counts, "day", "left").select("day", *zero)


def map_points(rows: DataFrame) -> DataFrame:
    return rows.where("latitude is not null and longitude is not null").select("feedback_id", "latitude", "longitude", "severity", "sentiment", "department")


def geo_key(city: Column, state: Column, lat: Column, lon: Column) -> Column:
    place = (F.length(city) > 0) & (F.length(state) > 0)
    return F.when(place, F.concat(city, F.lit(", "), state)).otherwise(F.format_string("%.1f,%.1f", lat, lon))


def geo_clusters(rows: DataFrame) -> DataFrame:
    """Bubbles of the map: place, centre, size, mean severity, counts by sentiment and department
    as maps, and the most frequent of either (the first name on ties)."""
    points = rows.where("latitude is not null and longitude is not null").withColumns(
        {
            "key": geo_key(F.col("location_city"), F.col("location_state"), F.col("latitude"), F.col("longitude")),
            "sentiment": F.coalesce("sentiment", F.lit("unknown")),
        }
    )
    whole = points.groupBy("key").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("n"), F.avg("severity").alias("mean_severity")
    )

    def counted(c: str) -> DataFrame:
        counts = points.where(F.length(c) > 0).groupBy("key", c).agg(F.count("*").alias("m"))
        entries = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), F.col(c).alias("v"))))
        got = counts.groupBy("key").agg(entries.alias("e"))
        as_map = F.map_from_entries(F.transform("e", lambda x: F.struct(x.v, -x.m)))
        return got.select("key", as_map.alias(f"{c}_counts"), F.get(F.col("e"), F.lit(0)).v.alias(f"top_{c}"))

    return whole.join(counted("sentiment"), "key", "left").join(counted("department"), "key", "left")


def choropleth(rows: DataFrame, states: DataFrame) -> DataFrame:
    """States with names, counts and bands relative to the largest; ``states`` is the fixed table
    of codes and names."""
    counts = by_state(rows).withColumnRenamed("location_state", "state_code")
    most = counts.agg(F.max("n").alias("most"))
    named = counts.join(F.broadcast(states), "state_code", "left").crossJoin(F.broadcast(most))  # one row
    return named.select("state_code", "state_name", "n", "mean_severity", choropleth_band(F.col("n"), F.col("most")).alias("band"))


def enrichment_analytics(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts by status; of completed rows the ten most frequent themes, mean severity and
    counts by language."""
    done = rows.where("enrichment_status = 'completed'")
    themes = done.select(F.explode("theme_labels").alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))
    return {
        "status": rows.groupBy("enrichment_status").agg(F.count("*").alias("n")),
        "top_themes": themes.orderBy(F.desc("n"), "theme").limit(10),
        "severity": done.agg(F.avg("severity_score").alias("mean_severity")),
        "language": done.groupBy("language_code").agg(F.count("*").alias("n")),
    }


def count_by_sentiment_progress(rows: DataFrame) -> DataFrame:
    """Counts by sentiment and progress with totals of either level."""
    rolled = rows.rollup("sentiment", "progress_state").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return rolled.select("sentiment", "progress_state", F.col("level").cast("long").alias("level"), "n")


def top_categories(rows: DataFrame, k: int = 5) -> DataFrame:
    counts = rows.where("sentiment = 'negative' and issue_category is not null").groupBy("issue_category").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "issue_category").limit(k)


def batch_summary(insights: DataFrame, failures: DataFrame) -> DataFrame:
    """Submitted, successful and failed records of each batch."""
    both = insights.select("batch_id", F.lit(1).alias("ok")).unionByName(failures.select("batch_id", F.lit(0).alias("ok")))
    return both.groupBy("batch_id").agg(F.count("*").alias("submitted"), F.sum("ok").alias("successful"), (F.count("*") - F.sum("ok")).alias("failures"))


def classification_accuracy(insights: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of labelled records whose set of themes is exactly right; 0 if none is evaluated."""

    def same(c: str) -> Column:
        return F.array_sort(F.array_distinct(c))

    joined = insights.select("feedback_id", "themes").join(truth.select("feedback_id", F.col("themes").alias("true_themes")), "feedback_id")
    right = (same("themes") == same("true_themes")).cast("double")
    return joined.agg(F.count("*").alias("evaluated"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))
