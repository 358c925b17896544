"""Intake of raw feedback: validation, channel projections and the preprocessing chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.functions import geo, text

LONGEST = 10_000


def _trim(c: str | Column) -> Column:
    """Without space, tab, CR and LF at the ends; other white space stays."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))


def assign_id(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """A repeatable id: the first key where present, else a hash of the keys."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    return df.withColumn(name, F.sha2(F.concat_ws("\x1f", *parts), 256))


def ingest_batch(raw: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``raw(id, source_channel, text, ...)`` with ``cleaned_text`` and ``reject_reason`` (null
    for good rows).  The first failing rule names the reason."""
    trimmed = _trim("text")
    reason = (
        F.when(F.col("source_channel").isNull() | ~F.col("source_channel").isin(R.CHANNELS), "invalid_channel")
        .when(F.coalesce(trimmed, F.lit("")) == "", "empty_text")
        .when(F.length(trimmed) > longest, "text_too_long")
    )
    return raw.withColumn("cleaned_text", trimmed).withColumn("reject_reason", reason)


def batch_size_policy(rows: DataFrame, ingest_limit: int = 1000, limit: int = 10_000) -> DataFrame:
    """Optional check: rows per ``batch_id`` and the limit that the count breaks, if any."""
    n = F.col("n_rows")
    verdict = F.when(n > limit, "over_processing_limit").when(n > ingest_limit, "over_ingest_limit")
    return rows.groupBy("batch_id").agg(F.count("*").alias("n_rows")).withColumn("violation", verdict)


def engagement_metrics(raw: Column) -> Column:
    """Likes, replies and reposts of a string map; the first non-zero of each metric's names."""

    def first(*names: str) -> Column:
        values = [F.nullif(F.element_at(raw, n).try_cast("int"), F.lit(0)) for n in names]
        return F.greatest(F.lit(0), F.coalesce(*values, F.lit(0)))

    return F.struct(
        first("likes", "favorites", "upvotes").alias("likes"),
        first("replies", "comments").alias("replies"),
        first("reposts", "retweets", "shares").alias("reposts"),
    )


def ingest_social(posts: DataFrame) -> DataFrame:
    """Posts of known platforms with at least three characters; text and handle cut to size."""
    platform = F.lower("platform")
    return (
        posts.where(platform.isin(R.PLATFORMS) & (F.length("message_text") >= 3))
        .withColumn("platform", platform)
        .withColumn("message_text", F.substring("message_text", 1, LONGEST))
        .withColumn("username_handle", F.substring("username_handle", 1, 320))
        .withColumn("language_code", F.coalesce(F.nullif("language_code", F.lit("")), F.lit("und")))
    )


def ingest_widget(forms: DataFrame) -> DataFrame:
    """``forms(payload)`` of raw JSON -> error_field, error_message and the parsed fields.

    Checked in order: consent present and boolean, text present, not blank and not too long,
    category known.  An unknown channel becomes ``website_form``.
    """
    v = F.try_parse_json("payload")
    consent = F.schema_of_variant(F.try_variant_get(v, "$.consent_to_contact", "variant"))
    message = F.try_variant_get(v, "$.message_text", "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.message_text", "variant")) == "STRING"
    category, channel = (F.try_variant_get(v, f"$.{c}", "string") for c in ("selected_category", "submission_channel"))
    rules = [
        (v.isNull(), "payload", "not valid JSON"),
        (consent.isNull() | (consent == "VOID"), "consent_to_contact", "is required"),
        (consent != "BOOLEAN", "consent_to_contact", "must be a boolean"),
        (message.isNull() | ~F.coalesce(is_text, F.lit(False)) | (text.strip_space(message) == ""), "message_text", "is required"),
        (F.length(message) > LONGEST, "message_text", "is too long"),
        (category.isNotNull() & ~category.isin(R.THEMES), "selected_category", "is unknown"),
    ]
    field = message_of = F.lit(None).cast("string")
    for bad, f, m in reversed(rules):
        field, message_of = F.when(bad, f).otherwise(field), F.when(bad, m).otherwise(message_of)
    known = ["website_form", "chat", "mobile_app", "support_portal"]
    return forms.select(
        "*",
        field.alias("error_field"),
        message_of.alias("error_message"),
        message.alias("message_text"),
        F.when(consent == "BOOLEAN", F.try_variant_get(v, "$.consent_to_contact", "boolean")).alias("consent_to_contact"),
        F.when(channel.isin(known), channel).otherwise("website_form").alias("submission_channel"),
        F.try_variant_get(v, "$.customer_id", "string").alias("customer_id"),
        F.try_variant_get(v, "$.account_type", "string").alias("account_type"),
        category.alias("selected_category"),
    )


def create_feedback(messages: DataFrame) -> DataFrame:
    """Free-form messages of 1 to 10,000 characters that are not blank, as pending feedback."""
    fine = F.length("text").between(1, LONGEST) & (text.strip_space(F.col("text")) != "")
    none = F.lit(None).cast("string")
    return messages.where(fine).select(
        "feedback_id",
        "text",
        F.lit("direct").alias("source_type"),
        F.lit("web_form").alias("channel"),
        none.alias("platform"),
        "created_at",
        F.lit("pending").alias("enrichment_status"),
        none.alias("sentiment"),
    )


def social_to_feedback(posts: DataFrame) -> DataFrame:
    """Accepted posts in the unified shape of ``create_feedback``."""
    none = F.lit(None).cast("string")
    return posts.select(
        "feedback_id",
        F.col("message_text").alias("text"),
        F.lit("social").alias("source_type"),
        none.alias("channel"),
        "platform",
        "created_at",
        F.lit("pending").alias("enrichment_status"),
        none.alias("sentiment"),
    )


def union_sources(messages: DataFrame, posts: DataFrame) -> DataFrame:
    return create_feedback(messages).unionByName(social_to_feedback(ingest_social(posts)))


def _errors(rules: list[tuple[str, Column]]) -> Column:
    found = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return F.filter(found, lambda e: e.isNotNull())


def _blank(c: str) -> Column:
    return F.coalesce(text.strip_space(F.col(c)), F.lit("")) == ""


def _length(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


def validate_submission(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Errors of a form by its sentiment, as field names in order."""
    s = F.col("sentiment")
    rules = [
        ("customer_name", ~_length("customer_name").between(1, 100)),
        ("core_request", ~_length("core_request").between(1, 5000)),
        ("sentiment", s.isNull() | ~s.isin(R.SENTIMENTS)),
        ("issue_category", (s == "negative") & ~F.coalesce(F.col("issue_category").isin(categories), F.lit(False))),
        ("detailed_description", (s == "negative") & (_length("detailed_description") < 10)),
        ("praise_text", (s == "positive") & ~_length("praise_text").between(1, 2000)),
        ("comment_text", (s == "neutral") & _blank("comment_text")),
    ]
    return rows.withColumn("errors", _errors(rules))


def validate_contact_form(rows: DataFrame) -> DataFrame:
    """Browser's rules for the first page, on trimmed fields."""
    name, email, phone, request = (F.coalesce(text.strip_space(F.col(c)), F.lit("")) for c in ("name", "email", "phone", "core_request"))
    rules = [
        ("name", ~F.length(name).between(1, 100)),
        ("contact", (email == "") & (phone == "")),
        ("email", (email != "") & ~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")),
        ("phone", (phone != "") & ~phone.rlike(r"^\+?\d{7,15}$")),
        ("core_request", ~F.length(request).between(1, 2000)),
    ]
    return rows.withColumn("errors", _errors(rules))


def build_canonical(social: DataFrame, widget: DataFrame) -> DataFrame:
    """Posts and form entries in one shape; each keeps its channel's own fields."""
    a = social.select(
        "feedback_id",
        F.lit("social").alias("source_type"),
        F.col("post_id").cast("string").alias("original_source_id"),
        F.col("message_text").alias("text"),
        "ingested_at",
        "platform",
        "username_handle",
        "engagement",
        "recency_score",
    )
    b = widget.select(
        "feedback_id",
        F.lit("widget").alias("source_type"),
        F.col("feedback_id").cast("string").alias("original_source_id"),
        F.col("message_text").alias("text"),
        "ingested_at",
        "submission_channel",
        "consent_to_contact",
        "customer_id",
        "account_type",
        "selected_category",
    )
    return a.unionByName(b, allowMissingColumns=True)


def preprocess(rows: DataFrame) -> DataFrame:
    """``rows(feedback_id, source_type, text, ...)`` cleaned, masked and marked; a text that is
    empty after cleaning has failed."""
    clean = rows.withColumn("cleaned", text.clean_text("text"))
    empty = F.coalesce(F.length("cleaned"), F.lit(0)) == 0
    return (
        clean.withColumn("masked_text", text.mask_pii(F.col("cleaned")))
        .withColumn("language", F.when(empty, "und").otherwise(text.detect_language(F.col("cleaned"))))
        .withColumn("profanity_detected", text.profanity_flag(F.col("cleaned")))
        .withColumn("processing_status", F.when(empty, "failed").otherwise("preprocessed"))
        .withColumn("reason", F.when(empty, "empty_after_cleaning"))
    )


def language_fallback(language: Column, confidence: Column, supported: list[str], least: float = 0.6) -> Column:
    """A model's answer as (language, confidence, uncertain)."""
    code = F.lower(language)
    bad = language.isNull() | confidence.isNull()
    unsure = bad | (confidence < least) | ~code.isin(supported)
    return F.struct(
        F.when(unsure, "en").otherwise(code).alias("language_code"),
        F.when(bad, 0.0).otherwise(confidence).alias("language_confidence"),
        unsure.alias("uncertain"),
    )
