"""Intake, text functions and constraints on boundary rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.functions import display, geo, hooks, text
from feedloom.operators import dedup, ingest, quality
from feedloom.operators import responses as Q
from feedloom.params import RuleParameters
from feedloom.plans import registry
from feedloom.sources import tables
from tests.oracle import TABLES, same


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_ingest_batch(spark):
    rows = [
        ("email", " \t a\r\n", "a", None), ("survey", "b", "b", None), ("call_transcript", "c", "c", None), ("social_post", "d", "d", None),
        ("fax", "a", "a", "invalid_channel"), (None, "a", "a", "invalid_channel"), ("fax", "  ", "", "invalid_channel"), ("email", " \n", "", "empty_text"), ("email", None, None, "empty_text"),
        ("email", " x ", " x ", None), ("email", " " + "x" * 10000, "x" * 10000, None), ("email", "x" * 10001, "x" * 10001, "text_too_long"),
    ]
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _, _) in enumerate(rows)], "id int, source_channel string, text string")
    got = ingest.ingest_batch(df).orderBy("id").collect()
    assert [(r.cleaned_text, r.reject_reason) for r in got] == [x[2:] for x in rows]


def test_clean_text(spark):
    cases = {
        "<b>a</b>  b": "a b", "a\tb": "a\tb", "a \n b": "a b", "  x ": "x", "é": "é", "a  b": "a b", "<p": "<p", "": "", " é ": "é",
    }
    assert column(spark, list(cases), text.clean_text) == list(cases.values())


def test_masks(spark):
    cases = {
        "ssn 123-45-6789.": "ssn [SSN].", "a.b+c@d-e.co.uk!": "[EMAIL]!", "call (555) 123-4567 now": "call [PHONE] now", "+1-555-123-4567": "[PHONE]", "5551234567": "[PHONE]", "12-34": "12-34",
    }
    assert column(spark, list(cases), text.mask_pii) == list(cases.values())
    df = spark.createDataFrame([("Hi, I am ANN (x) and ann (X); a@b.co, +1 555 123 4567", "Ann (X)"), ("a\\Eb", "a\\Eb"), ("keep", ""), ("keep", None)], "t string, n string")
    got = [r[0] for r in df.select(text.strip_pii_for_sharing(F.col("t"), F.col("n"))).collect()]
    assert got == ["Hi, I am [CUSTOMER] and [CUSTOMER]; [EMAIL REMOVED], [PHONE REMOVED]", "[CUSTOMER]", "keep", "keep"]
    assert column(spark, ["key-long key"], lambda c: text.redact_secrets(c, ["key", "key-long", " ", ""])) == ["[REDACTED] [REDACTED]"]


def slow_language(t):
    import re

    words = set(re.findall(r"\b[a-zA-ZÀ-ÿ]+\b", (t or "").lower()))
    if len((t or "").strip()) < 3 or not words:
        return "und"
    best, name = 0.0, "und"
    for lang, hints in R.LANGUAGE_HINTS.items():
        score = len(words & set(hints)) / len(words)
        if score > best:
            best, name = score, lang
    return name if best >= 0.1 else "und"


def test_language(spark):
    rng = random.Random(2)
    pool = [w for h in R.LANGUAGE_HINTS.values() for w in h] + ["zzz", "qqq", "www", "Über", "naïve"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(200)] + ["", "ab", None, "123 456", "the x y z q w e r t u"]
    assert column(spark, texts, text.detect_language) == [slow_language(t) for t in texts]


def test_small_text_functions(spark):
    assert column(spark, ["Damn!", "damnation", "HELL", "hello", "café ass", None], text.profanity_flag) == [True, False, True, False, True, False]
    assert column(spark, ["a-B 1é", ""], text.tokenize) == [["a", "b", "1"], []]
    assert column(spark, ["x" * 121, "y" * 120, "z" * 110 + " " * 20], text.text_preview) == ["x" * 120 + "…", "y" * 120, "z" * 110 + "…"]
    assert column(spark, ["A–b\t c ", None], text.normalize_text_key) == ["a-b c", None]
    names = ["Thanks to Marcus and thanks to marcus, kudos to MARCUS", "agent Bob Stone; Agent Bob Stone", "thank you Austin", "technician San Marco", "no names", None]
    assert column(spark, names, text.mentioned_names) == [["Marcus"], ["Bob Stone"], [], ["San Marco"], [], []]
    keys = column(spark, ["a10", "a9", "A2", "b"], text.natural_key)
    assert sorted(keys) == [keys[2], keys[1], keys[0], keys[3]]


def fnv(token):
    h = 2166136261
    for b in token.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % 256


def test_embedding_and_cosine(spark):
    words = ["a", "zebra", "42", "x" * 50]
    assert column(spark, words, text.fnv_bucket) == [fnv(w) for w in words]
    got = column(spark, ["a a zebra", ""], text.hash_embedding)
    assert got == [{fnv("a"): 2.0, fnv("zebra"): 1.0}, {}]
    df = spark.createDataFrame([("a b", "a b"), ("a", ""), ("", "!"), ("a b", "b c")], "x string, y string")
    cos = [r[0] for r in df.select(text.cosine_similarity(text.hash_embedding(F.col("x")), text.hash_embedding(F.col("y")))).collect()]
    assert cos == pytest.approx([1.0, 0.0, 1.0, 0.5])


def test_places_and_times(spark):
    assert column(spark, ["1,2", " 1.5 , -2 ", "91,0", "0,181", "a,b", "1,2,3", None], geo.parse_location) == [(1.0, 2.0), (1.5, -2.0), None, None, None, None, None]
    now = datetime(2024, 1, 31)
    ages = [0, 360, 720, 721, -1]
    df = spark.createDataFrame([(i, now - timedelta(hours=h)) for i, h in enumerate(ages)] + [(9, None)], "i int, t timestamp")
    assert [r[0] for r in df.orderBy("i").select(geo.recency_score(F.col("t"), F.lit(now))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0, 0.5]
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0]
    assert km == pytest.approx(6371 * 3.141592653589793 / 2)


def test_engagement(spark):
    maps = [{"likes": "0", "favorites": "7"}, {"likes": "x", "comments": "-3", "shares": "2"}, {}, None]
    got = column(spark, maps, ingest.engagement_metrics, "map<string,string>")
    assert [tuple(r) for r in got] == [(7, 0, 0), (0, 0, 2), (0, 0, 0), (0, 0, 0)]


def test_widget(spark):
    good = {"message_text": "hi", "consent_to_contact": True}
    cases = [
        (good, None), ({"message_text": "hi"}, "consent_to_contact"), (good | {"consent_to_contact": "yes"}, "consent_to_contact"), (good | {"consent_to_contact": None}, "consent_to_contact"),
        (good | {"message_text": " "}, "message_text"), (good | {"message_text": 5}, "message_text"), (good | {"message_text": "x" * 10001}, "message_text"), (good | {"selected_category": "x"}, "selected_category"),
        (good | {"selected_category": "billing"}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None), (98, "[")], "i int, payload string")
    got = {r.i: r.error_field for r in ingest.ingest_widget(df).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)} | {98: "payload", 99: "payload"}


def slow_dedup(rows, window):
    out, last = {}, {}
    for i, source, t, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        key = (source, t.lower())
        if key in last and ts - last[key][1] <= window:
            out[last[key][0]] += 1
        else:
            last[key] = (i, ts)
            out[i] = 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dedup(spark, seed):
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    rows = [(k, "social", "Same", day + timedelta(hours=h)) for k, h in enumerate((0, 10, 24, 25, 40, 50))]
    rows += [(10 + k, rng.choice(["social", "widget"]), rng.choice(["same", "SAME", "x"]), day + timedelta(hours=100 + rng.randrange(0, 200))) for k in range(120)]
    df = spark.createDataFrame(rows, "feedback_id long, source_type string, masked_text string, ts timestamp")
    got = {r.feedback_id: r.duplicate_count for r in dedup.dedup_24h(df).collect()}
    assert got == slow_dedup(rows, timedelta(hours=24))
    assert {0, 3, 5} <= set(got)


def test_display(spark):
    assert column(spark, [0.25, 0.75, 1.25, 5.0, 0.1, None], display.severity_to_ten, "double") == [1, 2, 2, 10, 1, None]
    themes = [["nothing", "Router BILL"], [], None, ["praise"]]
    assert column(spark, themes, display.department_for_themes, "array<string>") == ["Billing", "Customer Support", "Customer Support", "Marketing"]
    assert column(spark, [0, 20, 21, 41, 61, 81, 100], lambda c: display.choropleth_band(c, F.lit(100)), "int") == [0, 1, 2, 3, 4, 5, 5]


def test_constraints(spark):
    feedback = spark.createDataFrame([(1, "social", "a"), (1, "social", "b"), (2, "mail", " "), (3, None, "x" * 10001)], "feedback_id long, source_type string, text string")
    links = spark.createDataFrame([(1, 7), (9, 8)], "feedback_id long, ticket_id long")
    tickets = spark.createDataFrame([(7, "new"), (5, "odd")], "ticket_id long, ticket_phase string")
    got = {tuple(r) for r in quality.table_constraints({"feedback": feedback, "links": links, "tickets": tickets.withColumns({c: F.lit(None).cast("string") for c in ("priority_level", "assigned_department", "resolution_type")})}).collect()}
    assert got == {
        ("feedback", "1", "unique", "feedback_id"), ("feedback", "2", "enum", "source_type"), ("feedback", "2", "blank", "text"), ("feedback", "3", "not_null", "source_type"), ("feedback", "3", "length", "text"),
        ("links", "9", "reference", "feedback_id"), ("links", "9", "reference", "ticket_id"), ("tickets", "5", "enum", "ticket_phase"),
    }


def test_json_round_trip(spark):
    rows = [("a", 0.1234567, None), ("b", float("nan"), 1), ("c", float("inf"), 2)]
    got = [r[0] for r in tables.emit_json(spark.createDataFrame(rows, "z string, b double, a int")).collect()]
    assert got == ['{"a":null,"b":0.123457,"z":"a"}', '{"a":1,"b":null,"z":"b"}', '{"a":2,"b":null,"z":"c"}']
    good = {"feedback_id": "x", "sentiment_label": "neutral", "sentiment_score": 1, "processed_at": "2024-01-01T00:00:00Z"}
    bad = [good, good | {"sentiment_score": True}, good | {"sentiment_score": 1.01}, good | {"processed_at": "2024-01-01T00:00:00"}, good | {"sentiment_label": None}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bad)], "i int, json string")
    assert [r.error for r in tables.read_json_strict(df).orderBy("i").collect()] == [None, "sentiment_score", "sentiment_score", "processed_at", "sentiment_label"]


def test_batches_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 1), ("b2", 2), ("b1", 3)], "batch_id string, x int")
    tables.save_batch(rows, str(tmp_path / "t"))
    one = tables.get_batch(spark, str(tmp_path / "t"), "b1")
    assert sorted(r.x for r in one.collect()) == [1, 3]
    assert "PartitionFilters: [isnotnull(batch_id" in one._jdf.queryExecution().toString()
    tables.write_star({"a": rows, "b": rows}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "a")).count() == 3


def test_window_filter_reaches_the_scan(spark, tmp_path):
    from feedloom.operators import trends

    spark.createDataFrame([(datetime(2024, 1, 1), 1, "x")], "ts timestamp, a int, b string").write.parquet(str(tmp_path / "t"))
    df = trends.list_in_window(spark.read.parquet(str(tmp_path / "t")), "ts", datetime(2024, 1, 1), datetime(2024, 1, 2)).select("a")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp,a:int>" in plan


def test_parameters_and_hooks(spark):
    RuleParameters()
    for bad in ({"themes": ("billing",)}, {"review_threshold": 1.5}, {"theme_spike_pct": 0}, {"languages": ("fr",)}):
        with pytest.raises(ValueError):
            RuleParameters(**bad)
    embed = hooks.embedding_fn(lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert [list(r[0]) for r in spark.createDataFrame([("ab",), (None,)], "t string").select(embed("t")).collect()] == [[2.0, 1.0], [0.0, 1.0]]

    def call(prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return "{}"

    req = spark.createDataFrame([(1, "s", "ok"), (2, "s", "boom")], "feedback_id long, stage string, prompt string")
    got = sorted(map(tuple, hooks.generate_fn(req, call).collect()))
    assert got == [(1, "s", "{}", None), (2, "s", None, "RuntimeError")]


def test_entity_amounts_of_nothing_as_in_sql(spark, sf_dir, tmp_path):
    """Events that cost nothing keep their amount, as the query's SQL says; the rule's own least is a cent."""
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(F.col("value"))).write.parquet(str(tmp_path / "events.parquet"))
    same(registry.QUERIES["entity_rules"](spark, str(tmp_path)), registry.ORACLE["entity_rules"], str(tmp_path))
    cents = ["$0.00", "0.009", "0.01"]
    assert column(spark, cents, Q.normalize_dollar) == [None, None, "0.01"]
    assert column(spark, cents, lambda c: Q.normalize_dollar(c, 0.0)) == ["0.00", "0.01", "0.01"]


def test_language_splits_a_text_once(spark):
    """Each mention of the words in the expression would cost the regular expression again."""
    df = spark.createDataFrame([("the internet is very slow",)], "v string").select(text.detect_language(F.col("v")).alias("l"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
    plan = spark.createDataFrame([("x",)], "v string").repartition(2).select(text.detect_language(F.col("v")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
