"""Rules over language-model responses that are held in tables.

A response's raw JSON is parsed once to a variant; each rule answers with a struct that holds
either values or an ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules as R



def variant(raw: str | Column) -> Column:
    return F.try_parse_json(raw)


def kind(v: Column, path: str) -> Column:
    """Type of a field: null if it is missing, VOID for null, else its name."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")


def parse_enrichment(rows: DataFrame) -> DataFrame:
    """All or nothing: adds ``error`` (null for good answers) and the parsed ``themes``,
    ``sentiment``, ``sentiment_confidence``, ``severity_score`` and ``severity_factors``."""
    v = variant("raw_json")
    parsed = rows.withColumn("_v", v)
    v = F.col("_v")
    themes = F.try_variant_get(v, "$.themes", "array<struct<theme:string,confidence:double>>")
    factors = F.try_variant_get(v, "$.severity_factors", "array<string>")
    score = F.try_variant_get(v, "$.severity_score", "int")
    confidence = F.try_variant_get(v, "$.sentiment_confidence", "double")
    sentiment = F.try_variant_get(v, "$.sentiment", "string")
    allowed = F.array(*map(F.lit, ["themes", "sentiment", "sentiment_confidence", "severity_score", "severity_factors"]))
    keys = F.json_object_keys("raw_json")
    rules = [
        (v.isNull() | keys.isNull(), "not a JSON object"),
        (F.size(F.array_except(keys, allowed)) > 0, "unknown key"),
        (themes.isNull() | (F.size(themes) == 0), "themes missing"),
        (F.exists(themes, lambda t: t.theme.isNull() | ~F.coalesce(t.confidence.between(0, 1), F.lit(False))), "theme confidence out of range"),
        (sentiment.isNull() | ~sentiment.isin(R.SENTIMENTS), "unknown sentiment"),
        (~F.coalesce(_number(kind(v, "$.sentiment_confidence")) & confidence.between(0, 1), F.lit(False)), "sentiment confidence out of range"),
        (~F.coalesce((kind(v, "$.severity_score") == "BIGINT") & score.between(1, 5), F.lit(False)), "severity is no integer from 1 to 5"),
        (factors.isNull() | (F.size(factors) == 0) | F.exists(factors, lambda f: f.isNull() | ~F.length(f).between(1, 500)), "factors out of range"),
    ]
    error = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        error = F.when(bad, name).otherwise(error)
    return parsed.select(
        *rows.columns,
        error.alias("error"),
        themes.alias("themes"),
        sentiment.alias("sentiment"),
        confidence.alias("sentiment_confidence"),
        score.alias("severity_score"),
        factors.alias("severity_factors"),
    ).withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("themes", "sentiment", "sentiment_confidence", "severity_score", "severity_factors")})


def select_themes(themes: Column, labels: list[str] = R.MODEL_THEMES, least: float = 0.5) -> Column:
    """Known labels at enough confidence, the best of each, surest first, names breaking ties;
    ``other`` at 1 if there is none.  Stays inside the row."""
    fine = F.filter(themes, lambda t: t.theme.isin(labels) & (t.confidence >= least))
    names = F.array_distinct(F.transform(fine, lambda t: t.theme))
    best = F.transform(
        names, lambda n: F.struct((-F.array_max(F.transform(F.filter(fine, lambda t: t.theme == n), lambda t: t.confidence))).alias("c"), n.alias("theme"))
    )
    ordered = F.transform(F.array_sort(best), lambda x: F.struct(x.theme.alias("theme"), (-x.c).alias("confidence")))
    other = F.array(F.struct(F.lit("other").alias("theme"), F.lit(1.0).alias("confidence")))
    return F.when(F.size(F.coalesce(ordered, F.array().cast("array<struct<theme:string,confidence:double>>"))) > 0, ordered).otherwise(other)


def sentiment_rules(v: Column) -> Column:
    """(sentiment, confidence, note, error) of an answer."""
    value, confidence = F.try_variant_get(v, "$.sentiment", "string"), F.try_variant_get(v, "$.confidence", "double")
    text = F.lit(None).cast("string")
    error = (
        F.when(v.isNull(), "unparseable answer")
        .when(confidence.isNotNull() & ~confidence.between(0, 1), "confidence out of range")
        .when(value.isNotNull() & ~value.isin(R.SENTIMENTS), "unknown sentiment")
        .when(value.isNotNull() & confidence.isNull(), "confidence missing")
    )
    fine = error.isNull()
    return F.struct(
        F.when(fine, F.coalesce(value, F.lit("neutral"))).alias("sentiment"),
        F.when(fine, F.coalesce(confidence, F.lit(0.0))).alias("confidence"),
        F.when(fine & value.isNull(), "sentiment missing").otherwise(text).alias("note"),
        error.alias("error"),
    )


def severity_rules(raw: Column, v: Column) -> Column:
    """(score, factors, note, error); no answer, a missing or a null score is 1 with a note."""
    k = kind(v, "$.score")
    score = F.try_variant_get(v, "$.score", "int")
    factors = F.filter(F.try_variant_get(v, "$.factors", "array<string>"), lambda f: F.length(f).between(1, 500))
    missing = raw.isNull() | (v.isNotNull() & (k.isNull() | (k == "VOID")))
    error = F.when(raw.isNotNull() & v.isNull(), "unparseable answer").when(
        ~missing & (k != "BIGINT"), "score is no integer"
    ).when(~missing & ~F.coalesce(score.between(1, 5), F.lit(False)), "score out of range")
    fine = error.isNull()
    usual = F.array(F.lit("no factors given"))
    return F.struct(
        F.when(fine, F.when(missing, 1).otherwise(score)).alias("score"),
        F.when(fine, F.when(F.coalesce(F.size(factors), F.lit(0)) > 0, factors).otherwise(usual)).alias("factors"),
        F.when(fine & missing, "severity missing").alias("note"),
        error.alias("error"),
    )


def sentiment_score_rules(text: Column, v: Column) -> Column:
    """(score, label): short texts and unusable answers are neutral 0; true counts as 1; the
    label follows the score alone."""
    k = kind(v, "$.score")
    value = F.when(k == "BOOLEAN", F.try_variant_get(v, "$.score", "boolean").cast("double")).when(_number(k), F.try_variant_get(v, "$.score", "double"))
    score = F.when(F.length(text) < 5, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))
    label = F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    return F.struct(score.alias("score"), label.alias("label"))


def theme_blend(themes: Column, chosen: Column, weight: float = 0.4, least: float = 0.3) -> Column:
    """Primary and secondary theme of a model's answer and the customer's own category."""
    fine = F.filter(themes, lambda t: t.theme.isin(R.THEMES) & t.confidence.between(0, 1))
    names = F.array_distinct(F.transform(fine, lambda t: t.theme))
    names = F.when(chosen.isNotNull() & ~F.array_contains(names, chosen), F.concat(names, F.array(chosen))).otherwise(names)
    rest = 1 - weight

    def blended(n: Column) -> Column:
        own = F.array_max(F.transform(F.filter(fine, lambda t: t.theme == n), lambda t: t.confidence))
        return F.when(chosen.isNull(), own).when(chosen != n, rest * own).when(own.isNull(), weight).otherwise(F.least(F.lit(1.0), rest * own + weight))

    scored = F.array_sort(F.transform(names, lambda n, i: F.struct((-blended(n)).alias("c"), i.alias("i"), n.alias("theme"))))
    one, two = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
    return F.struct(
        F.when(-one.c >= least, one.theme).otherwise("unclassified").alias("theme_primary"),
        F.when(-two.c >= least, two.theme).alias("theme_secondary"),
        F.coalesce(-one.c, F.lit(0.0)).alias("confidence"),
    )


def intent_rules(intent: Column, confidence: Column, least: float = 0.4) -> Column:
    """(intent, confidence, requires_action)."""
    c = F.coalesce(confidence, F.lit(0.0))
    name = F.when(intent.isNull() | confidence.isNull() | (c <= least) | ~intent.isin(R.INTENTS), "unclassified").otherwise(intent)
    return F.struct(
        name.alias("intent"),
        F.when(intent.isNull() | confidence.isNull(), 0.0).otherwise(c).alias("confidence"),
        name.isin(R.ACTION_INTENTS).alias("requires_action"),
    )


def normalize_dollar(text: Column, least: float = 0.01) -> Column:
    """Two decimals, or null for what is no amount from ``least`` to 999,999,999.99."""
    value = F.regexp_replace(text, r"[,$€£¥\s]", "").try_cast("double")
    return F.when(value.between(least, 999_999_999.99), F.format_string("%.2f", value))


def entity_rules(entities: Column, most: int = 50, least_amount: float = 0.01) -> Column:
    """Known types at half confidence or more, values trimmed and cut, amounts from
    ``least_amount`` in one format."""

    def value(e: Column) -> Column:
        plain = F.substring(F.trim(e.entity_value), 1, 200)
        return F.when(e.entity_type == "dollar_amount", normalize_dollar(plain, least_amount)).otherwise(F.nullif(plain, F.lit("")))

    fine = F.filter(entities, lambda e: e.entity_type.isin(R.ENTITY_TYPES) & (e.confidence >= 0.5) & value(e).isNotNull())
    return F.slice(F.transform(fine, lambda e: F.struct(e.entity_type.alias("entity_type"), value(e).alias("entity_value"), e.confidence.alias("confidence"))), 1, most)


def location_rules(v: Column, city: str, state: str, lat: float, lon: float) -> Column:
    """The answer's place if it is whole, else the default place."""
    got = F.struct(
        F.try_variant_get(v, "$.city", "string").alias("city"),
        F.upper(F.try_variant_get(v, "$.state", "string")).alias("state"),
        F.try_variant_get(v, "$.latitude", "double").alias("latitude"),
        F.try_variant_get(v, "$.longitude", "double").alias("longitude"),
    )
    whole = (
        F.coalesce(F.try_variant_get(v, "$.mentioned", "boolean"), F.lit(False))
        & got.state.rlike("^[A-Z]{2}$")
        & _number(kind(v, "$.latitude"))
        & _number(kind(v, "$.longitude"))
    )
    usual = F.struct(F.lit(city).alias("city"), F.lit(state).alias("state"), F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude"))
    return F.when(F.coalesce(whole, F.lit(False)), got).otherwise(usual)


def first_usable_model(responses: DataFrame) -> DataFrame:
    """``responses(feedback_id, model_rank, usable, raw_json)``: the first usable answer in order
    of rank, else the last one tried."""
    one = F.struct("model_rank", "usable", "raw_json")
    best = F.coalesce(F.min_by(F.when(F.col("usable"), one), F.when(F.col("usable"), F.col("model_rank"))), F.max_by(one, "model_rank"))
    return responses.groupBy("feedback_id").agg(best.alias("b")).select("feedback_id", "b.*")


def enrichment_columns(rows: DataFrame) -> DataFrame:
    """Columns of the unified table from a completed insight."""
    from feedloom.functions.display import department_for_themes, severity_to_ten

    return rows.withColumns(
        {
            "severity": severity_to_ten(F.col("severity_score")),
            "severity_reasoning": F.array_join("severity_factors", "; "),
            "department": department_for_themes(F.transform("themes", lambda t: t.theme)),
            "enrichment_status": F.lit("completed"),
        }
    )


def enrichment_status(done: Column, timed_out: Column, stage: Column, reason: Column) -> Column:
    """(status, note) of a record's answers and first failure."""
    failed = F.when(stage.isNotNull(), F.concat(F.lit("["), stage, F.lit("] "), F.coalesce(reason, F.lit("")))).otherwise("no insight records")
    return F.struct(
        F.when(timed_out, "timeout").when(done, "completed").otherwise("failed").alias("status"),
        F.when(~timed_out & ~done, failed).alias("note"),
    )


STAGES = ["classification", "sentiment", "severity", "clustering"]


def stage_failure(errors: dict[str, Column]) -> Column:
    """(stage, reason) of the first failing stage, or null."""
    return F.coalesce(*[F.when(errors[s].isNotNull(), F.struct(F.lit(s).alias("stage"), errors[s].alias("reason"))) for s in STAGES if s in errors])


def build_prompts(rows: DataFrame, stages: list[str], names: DataFrame) -> DataFrame:
    """A request per record and stage; texts in other languages get a clause that names it.
    ``names(language_code, language_name)`` is a table of languages, of bounded size."""
    rows = rows.join(F.broadcast(names), "language_code", "left")
    other = F.col("language_code") != "en"
    clause = F.when(other, F.concat(F.lit("The text is in "), F.coalesce("language_name", "language_code"), F.lit(". Answer in English.\n"))).otherwise("")
    stage = F.explode(F.array(*map(F.lit, stages)))
    return rows.withColumn("stage", stage).select(
        "feedback_id", "stage", F.concat(clause, F.lit("Stage: "), "stage", F.lit("\n"), "text").alias("prompt")
    )


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with ``hit`` and the cached ``enrichment``; an entry that expires now is a miss."""
    live = cache.where(F.col("expires_at") > now).select("key", "enrichment")
    return requests.join(live, "key", "left").withColumn("hit", F.col("enrichment").isNotNull())


def cache_put(cache: DataFrame, fresh: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """The cache with newer entries in place of older ones of a key."""
    if not 1 <= ttl_hours <= 720:
        raise ValueError("a cache entry lives 1 to 720 hours")
    added = fresh.withColumn("expires_at", F.col("created_at") + F.expr(f"interval {ttl_hours} hours"))
    both = cache.unionByName(added)
    one = F.struct("created_at", "expires_at", "enrichment")
    return both.groupBy("key").agg(F.max(one).alias("e")).select("key", "e.*")


def cache_purge(cache: DataFrame, cutoff: Column) -> DataFrame:
    return cache.where(F.col("expires_at") >= cutoff)
