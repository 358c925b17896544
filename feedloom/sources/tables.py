"""Readers and writers of feedback tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_FEEDBACK = T.StructType(
    [
        T.StructField("source_channel", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def src_feedback(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType = RAW_FEEDBACK, stream: bool = False) -> DataFrame:
    """Raw feedback from files, in a batch or as a stream; the schema is never inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(kind).load(path)


def save_batch(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows by ``batch_id``, so that reading one batch prunes the rest."""
    rows.write.mode(mode).partitionBy("batch_id").parquet(path)


def get_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("batch_id") == batch_id)


def list_batches(batches: DataFrame, insights: DataFrame, start: Column, end: Column) -> DataFrame:
    """Batches of the half-open window with their insights counted, oldest first."""
    counts = insights.groupBy("batch_id").agg(F.count("*").alias("record_count"))
    within = batches.where((F.col("batch_ts") >= start) & (F.col("batch_ts") < end))
    joined = within.join(counts, "batch_id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0).cast("long")))
    return joined.orderBy("batch_ts", "batch_id")


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6))
    return c


def emit_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One canonical JSON text a row: names sorted, no blanks, six decimals, null for what is no
    finite number."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    one = F.struct(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return rows.select(F.to_json(one, {"ignoreNullFields": "false"}).alias(name))


TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def read_json_strict(rows: DataFrame, column: str = "json") -> DataFrame:
    """Analysis rows from JSON with ``error``: malformed text, wrong type, range, set or time."""
    from feedloom import rules as R

    v = F.try_parse_json(column)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    number = lambda p: kind(p).isin("BIGINT", "DOUBLE") | kind(p).startswith("DECIMAL")
    score = F.try_variant_get(v, "$.sentiment_score", "double")
    text = lambda p: F.try_variant_get(v, p, "string")
    no = F.lit(False)
    checks = [
        (v.isNull(), "malformed"),
        (~F.coalesce(kind("$.feedback_id").isin("STRING", "BIGINT"), no), "feedback_id"),
        (~F.coalesce(text("$.sentiment_label").isin(R.SENTIMENTS), no), "sentiment_label"),
        (~F.coalesce(number("$.sentiment_score") & score.between(-1, 1), no), "sentiment_score"),
        (~F.coalesce(text("$.processed_at").rlike(TIME), no), "processed_at"),
    ]
    error = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        error = F.when(bad, name).otherwise(error)
    return rows.select(
        "*",
        error.alias("error"),
        text("$.feedback_id").alias("feedback_id"),
        text("$.sentiment_label").alias("sentiment_label"),
        score.alias("sentiment_score"),
        F.try_to_timestamp(text("$.processed_at")).alias("processed_at"),
    )
