"""Triage, priority, routing, tickets, trends and clusters against plain Python."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from feedloom import rules as R
from feedloom.operators import clusters as C
from feedloom.operators import tickets as K
from feedloom.operators import trends as T
from feedloom.operators import triage as G


def test_triage_table(spark):
    rows = list(product(["completed", "pending", None], ["positive", "neutral", "negative", None], [1, 2, 3, 5, None]))

    def slow(status, mood, sev):
        if status != "completed":
            return "review"
        if mood == "negative" and sev is not None and sev >= 3:
            return "action_required"
        if mood in ("positive", "neutral") and sev is not None and sev <= 2:
            return "no_action"
        return "review"

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c int")
    got = [r[0] for r in df.orderBy("i").select(G.triage_decide(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [slow(*r) for r in rows]


def test_priority_boundaries(spark):
    rows = [
        ("an outage", -0.71, "praise", False, 0, "critical", 0.75 + 0.1 + 0.01 / 0.3 * 0.1),
        ("an outage", -0.7, "praise", False, 0, "high", 0.62),
        ("my lawyer", 0.5, "praise", False, 0, "critical", 0.9),
        ("outage, FCC", -0.9, "praise", False, 0, "critical", 1.0),
        ("CEO", -0.85, "praise", False, 0, "critical", 0.95),
        ("x", -0.5, "praise", False, 11, "high", 0.5 + 1 / 40 * 0.12),
        ("x", -0.5, "praise", False, 10, "medium", 0.37),
        ("x", -0.2, "praise", False, None, "low", 0.12),
        ("x", 0.0, "request_for_help", True, 0, "medium", 0.35),
        ("x", 0.3, "complaint", True, 0, "low", 0.06),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, t string, s double, n string, a boolean, v int")
    p = G.priority_score(F.col("t"), F.col("s"), F.col("n"), F.col("a"), F.col("v"))
    got = [tuple(r[0]) for r in df.orderBy("i").select(p).collect()]
    assert [g[0] for g in got] == [r[5] for r in rows]
    assert [g[1] for g in got] == pytest.approx([r[6] for r in rows])


def simulate(rows, tickets, links):
    """The rules one record at a time."""
    of = {r["feedback_id"]: r["customer_id"] for r in rows}
    phase = {t[0]: t[1] for t in tickets}
    open_links = {}
    for f, t in links:
        if phase.get(t) in R.OPEN_PHASES and f in of:
            open_links[of[f]] = open_links.get(of[f], 0) + 1
    by_cluster = {}
    for t, p, updated, cluster in tickets:
        by_cluster.setdefault(cluster, []).append((p in R.OPEN_PHASES, updated, t))
    out = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["feedback_id"])):
        social = r["engagement"] if r["source_type"] == "social" else 0
        own = by_cluster.setdefault(r["cluster_id"], []) if r["cluster_id"] is not None else []
        open_ = sorted(x for x in own if x[0])
        escalate = r["priority_level"] == "critical" or any(w in r["text"].lower() for w in R.LEGAL_WORDS) or (r["account_type"] == "high_value" and open_links.get(r["customer_id"], 0) >= 3) or social > 1000
        new = f"new{r['feedback_id']}"
        if escalate:
            out[r["feedback_id"]] = ("escalate", None, None)
            own.append((True, r["ts"] + timedelta(days=9999), new))
        elif open_:
            out[r["feedback_id"]] = ("route_to_existing", open_[-1][2], None)
        elif r["requires_action"] and r["priority_level"] in ("medium", "high"):
            out[r["feedback_id"]] = ("create_ticket", None, None)
            own.append((True, r["ts"] + timedelta(days=9999), new))
        else:
            if r["duplicate_count"] > 0:
                why = "duplicate"
            elif r["intent"] == "praise" and r["priority_level"] == "low" and not r["requires_action"]:
                why = "no_action_required"
            elif own:
                why = "known_resolved"
            elif r["intent"] == "request_for_help" and r["priority_level"] == "low" and r["theme_primary"] in R.FAQ_TOPICS:
                why = "faq_matched"
            else:
                why = "no_action_required"
            out[r["feedback_id"]] = ("auto_resolve", None, why)
            own.append((False, r["ts"], new))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_routing_equals_simulation(spark, seed):
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    rows = [
        dict(
            feedback_id=i, ts=day + timedelta(minutes=rng.randrange(500)), customer_id=rng.randrange(12), account_type=rng.choice(["high_value", "basic"]), source_type=rng.choice(["social", "widget"]),
            engagement=rng.choice([0, 100, 101, 1000, 1001]), text=rng.choice(["hello"] * 9 + ["class action"]), theme_primary=rng.choice(R.THEMES), intent=rng.choice(R.INTENTS),
            priority_level=rng.choice(["low"] * 6 + ["medium", "high", "critical"]), requires_action=rng.random() < 0.4, duplicate_count=int(rng.random() < 0.1), cluster_id=rng.choice([None, *range(25)]),
        )
        for i in range(150)
    ]
    tickets = [(1000 + k, rng.choice(R.PHASES), day - timedelta(days=k), rng.randrange(25)) for k in range(14)]
    links = [(rng.randrange(150), rng.choice(tickets)[0]) for _ in range(60)]
    schema = "feedback_id long, ts timestamp, customer_id long, account_type string, source_type string, engagement int, text string, theme_primary string, intent string, priority_level string, requires_action boolean, duplicate_count int, cluster_id long"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    t = spark.createDataFrame([(*x, "Retention") for x in tickets], "ticket_id long, ticket_phase string, updated_at timestamp, linked_cluster_id long, assigned_department string")
    got = G.routing_decision(df, t, spark.createDataFrame(links, "feedback_id long, ticket_id long")).collect()
    names = {r.new_ticket_id: f"new{r.feedback_id}" for r in got if r.new_ticket_id}
    want = simulate(rows, tickets, links)
    for r in got:
        action, link, why = want[r.feedback_id]
        assert (r.routing_action, r.resolution_type) == (action, why), r
        if link is not None and not str(link).startswith("new"):
            assert r.linked_ticket_id == str(link)
        elif link is not None:
            assert names[r.linked_ticket_id] == link
    assert len(got) == 150


def test_every_pair_of_phases(spark):
    tickets = spark.createDataFrame([(i, p) for i, p in enumerate(R.PHASES)], "ticket_id long, ticket_phase string")
    asked = [(i, k, q, "resolved_by_agent", "me" * 100) for i in range(8) for k, q in [(0, R.PHASES[(i * 3) % 8])]]
    asked += [(3, 1, "resolved", None, "a"), (3, 2, "resolved", "resolved_by_agent", "a"), (3, 3, "closed", None, "a"), (3, 4, "new", None, "a"), (99, 0, "new", None, "a")]
    got = K.ticket_phase_transition(tickets, spark.createDataFrame(asked, "ticket_id long, seq long, new_phase string, resolution_type string, actor string")).collect()
    phase = dict(enumerate(R.PHASES))
    want = []
    for t, s, q, res, _ in sorted(asked[:-1], key=lambda a: (a[0], a[1])):
        error = "invalid_transition" if q not in R.NEXT_PHASES[phase[t]] else "resolution_type_required" if q == "resolved" and not res else None
        want.append((t, s, phase[t], q, error))
        phase[t] = q if error is None else phase[t]
    assert sorted((r.ticket_id, r.seq, r.previous_phase, r.new_phase, r.error) for r in got) == sorted(want, key=lambda w: (w[0], w[1]))
    assert all(len(r.actor) <= 150 for r in got)


def test_windows():
    a, b, c, d = (datetime(2024, 1, k) for k in (1, 5, 5, 9))
    T.Windows(a, b, c, d)
    for bad in ((b, a, c, d), (a, a, c, d), (a, d, b, datetime(2024, 2, 1))):
        with pytest.raises(ValueError):
            T.Windows(*bad)
    with pytest.raises(ValueError):
        T.Windows.parse("2024-01-01", "x", "2024-02-01", "2024-03-01")
    assert T.Windows.parse("2024-01-01T00:00:00Z", "2024-01-02", "2024-01-02", "2024-01-03").baseline_start == a


def test_trend_thresholds(spark):
    day = datetime(2024, 1, 1)
    w = T.Windows(day, day + timedelta(days=1), day + timedelta(days=1), day + timedelta(days=2))

    def rows(n, themes, negative, severity, at):
        return [(at, [themes[k % len(themes)]], "negative" if k < negative else "positive", severity) for k in range(n)]

    schema = "ts timestamp, theme_labels array<string>, sentiment string, severity_score int"
    base, cur = day, day + timedelta(days=1)
    few = spark.createDataFrame(rows(9, ["a"], 1, 1, base) + rows(10, ["a"], 9, 5, cur), schema)
    assert [r.kind for r in T.trend_report(few, "ts", w).collect()] == ["note"]
    enough = spark.createDataFrame(rows(20, ["a", "b", "b", "b"], 3, 2, base) + rows(20, ["a", "b", "c", "b"], 6, 3, cur), schema)
    got = {(r.kind, r.name): r.change for r in T.trend_report(enough, "ts", w).collect()}
    assert set(got) == {("theme_spike", "c"), ("sentiment_shift", "negative"), ("severity_escalation", "severity")}
    assert got[("sentiment_shift", "negative")] == pytest.approx(15.0) and got[("severity_escalation", "severity")] == 1.0


def test_cluster_trend_boundaries(spark):
    day = datetime(2024, 1, 1)

    def scores(cluster, values):
        return [(cluster, k, day + timedelta(hours=k), v) for k, v in enumerate(values)]

    rows = scores("few", [0.0] * 9 + [1.0] * 10) + scores("up", [0.0] * 10 + [0.5] * 10) + scores("same", [0.0] * 10 + [0.1] * 10) + scores("down", [0.5] * 15 + [0.0] * 15)
    got = {r.cluster_id: (r.trend, r.too_few) for r in T.cluster_sentiment_trend(spark.createDataFrame(rows, "cluster_id string, feedback_id long, processed_at timestamp, sentiment_score double")).collect()}
    assert got == {"few": ("stable", True), "up": ("improving", False), "same": ("stable", False), "down": ("deteriorating", False)}


def test_lifecycle_and_spikes(spark):
    now = datetime(2024, 2, 1)
    rows = [("active", 7, "active"), ("active", 8, "monitoring"), ("monitoring", 21, "monitoring"), ("monitoring", 22, "resolved"), ("resolved", 99, "resolved"), ("active", 99, "monitoring")]
    df = spark.createDataFrame([(i, s, now - timedelta(days=d)) for i, (s, d, _) in enumerate(rows)], "i int, status string, last_seen_at timestamp")
    assert [r.status for r in T.cluster_lifecycle(df, F.lit(now)).orderBy("i").collect()] == [r[2] for r in rows]
    day = datetime(2024, 1, 1)
    counts = {"up": [1] * 7 + [3], "twice": [1] * 7 + [2], "new": [0] * 7 + [5], "short": [1]}
    events = [(t, day + timedelta(days=k)) for t, ns in counts.items() for k, n in enumerate(ns) for _ in range(n)]
    got = {r.theme: r.spike for r in T.volume_spike(T.daily_theme_counts(spark.createDataFrame(events, "theme string, ts timestamp"), "ts", "theme")).collect()}
    assert got == {"up": True, "twice": False, "new": False, "short": False}


def slow_single_linkage(texts, threshold):
    vectors = [C._bucketed(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if C._similar(vectors[i], vectors[j]) >= threshold - 1e-12:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0, 0.0])
def test_single_linkage(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["bill", "late", "modem", "slow", "net", "down", "help", "agent"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["", "!!", "bill late", "late bill"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(C.single_linkage_clusters(df, threshold).collect())
    want = slow_single_linkage(texts, threshold) if threshold > 0 else [0] * len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert C.single_linkage_clusters(df, 0.5).collect() == []


def test_leader_clusters(spark):
    day = datetime(2024, 1, 1)
    rows = [
        (1, "billing", day, "bill is wrong", 30.0, -97.0), (2, "billing", day + timedelta(hours=1), "bill is wrong", 30.0, -97.0), (3, "outage", day, "bill is wrong", 30.0, -97.0),
        (4, "billing", day + timedelta(hours=2), "bill is wrong", None, None), (5, "billing", day + timedelta(hours=3), "Cluster of 2 feedback items about billing", 30.1, -97.0),
    ]
    df = spark.createDataFrame(rows, "feedback_id long, theme string, ts timestamp, text string, latitude double, longitude double")
    got = {r.feedback_id: r.cluster_id for r in C.online_clusters(df).collect()}
    assert got[1] == got[2] and got[3] == "outage:3" and got[4] == "billing:4"
    assert got[5] == got[1]  # from the second member on, the summary sentence stands for the cluster


def test_labels_and_rank(spark):
    rows = [(1, 1, "b a b"), (1, 2, "a b"), (2, 3, "!!"), (2, 4, "??"), (3, 5, "  "), (4, 6, " ".join(f"w{i:03d}" for i in range(80)))]
    got = dict(C.cluster_label(spark.createDataFrame(rows, "component int, id int, text string")).collect())
    assert got[1] == "b a" and got[2] == "!!" and got[3] == "5" and len(got[4]) <= 120
    ranks = spark.createDataFrame([("x", 5.0, 2, "b"), ("y", 5.0, 2, "a"), ("z", 9.0, 1, "c"), ("w", 5.0, 3, "d")], "cluster_id string, priority double, n_members int, label string")
    assert {r.cluster_id: r["rank"] for r in C.cluster_rank(ranks).collect()} == {"z": 1, "w": 2, "y": 3, "x": 4}


def test_migration_is_idempotent(spark):
    legacy = spark.createDataFrame([(1, 10, "c", "d", "p", "open", datetime(2024, 1, 1))], "ticket_id long, submission_id long, issue_category string, description string, priority string, status string, created_at timestamp")
    subs = spark.createDataFrame([(10, "t", datetime(2024, 1, 1), "negative"), (11, "u", datetime(2024, 1, 1), "neutral")], "submission_id long, text string, created_at timestamp, sentiment string")
    queue = subs.where("submission_id = 11").select("submission_id")
    tickets = legacy.limit(0).select("ticket_id", F.col("issue_category").alias("category"), "description", "priority", "status", "created_at")
    feedback = spark.createDataFrame([], "feedback_id long, text string, created_at timestamp, sentiment string, triage_outcome string, needs_review boolean, ticket_id long")
    one = K.migrate_legacy(legacy, subs, queue, tickets, feedback)
    two = K.migrate_legacy(legacy, subs, queue, one["tickets"], one["feedback"])
    assert sorted(map(tuple, one["feedback"].collect())) == sorted(map(tuple, two["feedback"].collect()))
    assert {r.table_name: (r.read, r.written) for r in one["report"].collect()} == {"tickets": (1, 1), "feedback": (2, 2)}
    assert {r.written for r in two["report"].collect()} == {0}


def test_cascade_leaves_rows_without_a_ticket_out_of_the_join(spark):
    """Rows without a ticket would all meet in one task."""
    feedback = spark.range(4000).select(F.col("id").alias("feedback_id"), F.when(F.col("id") % 4 == 0, F.col("id") % 100).alias("ticket_id"))
    feedback = feedback.union(spark.createDataFrame([(1, 8), (None, None), (None, 4)], "a long, b long"))
    tickets = spark.range(0, 100, 4).select(F.col("id").alias("ticket_id")).union(spark.createDataFrame([(None,)], "a long"))
    doomed = spark.createDataFrame([(1,), (4,), (None,)], "feedback_id long")
    got = K.cascade_delete(tickets, tickets, feedback, doomed)
    rows = [tuple(r) for r in feedback.collect()]
    gone = {t for i, t in rows if i in (1, 4)} - {None}
    alone = {i for i, t in rows if i in (1, 4) and t is None}
    want = [r for r in rows if r[1] not in gone and r[0] not in alone]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got["feedback"].select("feedback_id", "ticket_id").collect())
    assert {r.table_name: r.removed for r in got["counts"].collect()} == {"tickets": 2, "comments": 2, "feedback": len(rows) - len(want)}
    plan = got["feedback"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") >= 2 and "isnotnull(ticket_id" in plan and "isnull(ticket_id" in plan
