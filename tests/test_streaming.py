"""Streaming twins on file sources, run until all input is read."""

import random
from datetime import datetime, timedelta

from feedloom.operators import triage as G
from feedloom.operators.clusters import online_clusters
from feedloom.operators.triage import routing_decision
from feedloom.sources.tables import src_feedback
from feedloom.sources.versions import Versions
from feedloom.streaming import streams as S
from feedloom.streaming.lifecycle import stream_lifecycle

DAY = datetime(2024, 1, 1)


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def files(spark, rows, schema, path, batches=1):
    """Each batch a file, read one a trigger."""
    for k, part in enumerate(rows if batches > 1 else [rows]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest(spark, tmp_path):
    rows = [("email", "ok", {}), ("fax", "no", {}), ("email", " ", {})]
    spark.createDataFrame(rows, "source_channel string, text string, metadata map<string,string>").write.parquet(str(tmp_path / "in"))
    good, bad = [], []
    q = S.stream_ingest(src_feedback(spark, str(tmp_path / "in"), stream=True), lambda d, e: good.extend(d.collect()), lambda d, e: bad.extend(d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.cleaned_text for r in good] == ["ok"] and sorted(r.reject_reason for r in bad) == ["empty_text", "invalid_channel"]


class Sink:
    def __init__(self):
        self.batches = {}

    def __call__(self, df, epoch):
        self.batches[epoch] = [r.asDict() for r in df.collect()]

    @property
    def rows(self):
        return [r for b in self.batches.values() for r in b]


DEDUP = "source_type string, masked_text string, ts timestamp, feedback_id long"


def test_dedup(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    rows = [[("s", "A", at(0), 1), ("s", "a", at(10), 2)], [("s", "a", at(24), 3), ("s", "a", at(25), 4)], [("s", "a", at(40), 5), ("s", "a", at(50), 6), ("t", "a", at(50), 7)], [("s", "a", at(30), 8), ("s", "a", at(20), 9), ("s", None, None, 10)]]
    sink = Sink()
    S.stream_dedup(files(spark, rows, DEDUP, tmp_path / "in", 4), sink, str(tmp_path / "state")).awaitTermination(300)
    got = {r["feedback_id"]: r for r in sink.rows}
    assert {k: r["is_original"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True}
    assert got[3]["duplicate_count"] == 2 and got[8]["original_id"] == 6 and got[9]["original_id"] == 9 and len(sink.batches) == 4


def running(rows, window):
    """original_id and duplicate_count of each record, in order of time."""
    out, last = {}, {}
    for source, text, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        key = source, (text or "").lower()
        if key in last and t - last[key][0] <= window:
            last[key][2] += 1
        else:
            last[key] = [t, i, 0]
        out[i] = last[key][1], last[key][2]
    return out


def test_dedup_of_many_batches(spark, tmp_path):
    """Batches in order of time give what one fold gives; a key holds half of each batch."""
    rng = random.Random(4)
    rows = sorted(((rng.choice("st"), rng.choice(["Hot", "hot", "a", None]), DAY + timedelta(minutes=rng.randrange(0, 60 * 24 * 12)), i) for i in range(400)), key=lambda r: (r[2], r[3]))
    sink = Sink()
    S.stream_dedup(files(spark, [rows[k : k + 80] for k in range(0, 400, 80)], DEDUP, tmp_path / "in", 5), sink, str(tmp_path / "state")).awaitTermination(300)
    assert len(sink.batches) == 5
    assert {r["feedback_id"]: (r["original_id"], r["duplicate_count"]) for r in sink.rows} == running(rows, timedelta(days=1))
    # what no record can meet any more has gone: one anchor of each key is left at most
    state = Versions(spark, f"{tmp_path}/state/anchors", S.ANCHORS, ["source_type", "text_key"])
    assert state.before(5).count() <= 6


def test_versions(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "v"), "k long, x string", ["k"], fold=3)
    df = lambda rows: spark.createDataFrame(rows, "k long, x string, gone boolean")
    now = {}
    for epoch in range(8):
        assert {r.k: r.x for r in t.before(epoch).collect()} == now
        rows = [(epoch, "new", False), (epoch - 1, "again", False), (epoch - 3, "out", True)]
        for _ in range(2):  # a replay overwrites its version
            t.write(df(rows), epoch)
        now = {**now, epoch: "new", epoch - 1: "again"}
        now.pop(epoch - 3, None)
    assert {r.k: r.x for r in t.before(3).collect()} == {2: "new", 1: "again", 0: "again"}


def test_theme_counts(spark, tmp_path):
    rows = [[("a", DAY), ("a", DAY + timedelta(hours=1)), ("b", DAY)], [("a", DAY + timedelta(days=9))]]
    df = files(spark, rows, "theme string, ts timestamp", tmp_path / "in", 2)
    got = run(spark, S.stream_theme_counts(df), "themes_out", tmp_path)
    assert {(r.theme, r.n) for r in got} == {("a", 2), ("b", 1)}


def test_late_rows(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    rows = [[(1, at(0)), (2, at(4))], [(3, at(1)), (4, at(3.5))], [(5, at(2.9)), (6, at(9))], [(7, at(3))]]
    sink = Sink()
    S.stream_late_rows(files(spark, rows, "id long, ts timestamp", tmp_path / "in", 4), sink, str(tmp_path / "state")).awaitTermination(300)
    assert {k: sorted(r["id"] for r in b) for k, b in sink.batches.items()} == {0: [], 1: [3], 2: [5], 3: [7]}


CLUSTERED = "feedback_id long, theme string, ts timestamp, text string, latitude double, longitude double"


def test_clusters(spark, tmp_path):
    """Batches give what the batch operator gives for all records; idle clusters take no record."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        place = rng.choice([(None, None), (30.0, -97.0), (30.2, -97.1), (50.0, 8.0)])
        text = rng.choice(["bill is wrong", "bill was wrong", "my bill", "Cluster of 2 feedback items about billing", "", None, "slow today"])
        rows.append((i, rng.choice(["billing", "outage", None]), DAY + timedelta(hours=12 * i + (600 if i > 120 else 0)), text, *place))
    sink = Sink()
    S.stream_clusters(files(spark, [rows[k : k + 50] for k in range(0, 240, 50)], CLUSTERED, tmp_path / "in", 5), sink, str(tmp_path / "state")).awaitTermination(300)
    got = {r["feedback_id"]: r["cluster_id"] for r in sink.rows}
    batch = spark.createDataFrame(rows, CLUSTERED)
    assert len(sink.batches) == 5 and got == {r.feedback_id: r.cluster_id for r in online_clusters(batch, 21).collect()}
    assert got != {r.feedback_id: r.cluster_id for r in online_clusters(batch).collect()}
    state = Versions(spark, f"{tmp_path}/state/clusters", S.CLUSTERS, ["cluster_id"])
    latest = {}
    for i, theme, t, *_ in rows:
        if theme:
            latest[theme] = t
    assert all(latest[r.theme] - DAY - timedelta(microseconds=r.seen - int(DAY.timestamp() * 1e6)) <= timedelta(days=21) for r in state.before(5).collect())
    assert state.before(5).count() < len(set(got.values()))


def test_lifecycle(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    days = {"a": [0, 3, 9.9, 30], "b": [0, 8, 40], "c": [0], "d": [0, 5, 11, 12, 70]}
    events = sorted((d, c) for c, ds in days.items() for d in ds)
    events = [(c, at(d)) for d, c in events] + [("end", at(100))]
    want = {("a", "active", 0), ("a", "monitoring", 16.9), ("a", "resolved", 51), ("b", "active", 0), ("b", "monitoring", 7), ("b", "resolved", 29), ("c", "active", 0), ("c", "monitoring", 7), ("c", "resolved", 21),
            ("d", "active", 0), ("d", "monitoring", 19), ("d", "resolved", 33), ("end", "active", 100)}
    for size in (2, 5, 50):  # however the stream is cut
        parts = [events[k : k + size] for k in range(0, len(events), size)]
        df = files(spark, parts, "cluster_id string, ts timestamp", tmp_path / f"in{size}", 2)
        got = run(spark, stream_lifecycle(df), f"life_{size}", tmp_path)
        assert {(r.cluster_id, r.status, (r["at"] - DAY) / timedelta(days=1)) for r in got} == want and len(got) == len(want)


def test_status(spark, tmp_path):
    fb = files(spark, [[(1, DAY), (2, DAY), (3, DAY)], [(99, DAY + timedelta(hours=1))], [(100, DAY + timedelta(hours=2))]], "feedback_id long, ts timestamp", tmp_path / "f", 3)
    rs = files(spark, [[(1, DAY + timedelta(seconds=30), True), (2, DAY + timedelta(seconds=1), False), (3, DAY + timedelta(seconds=31), True)], [(98, DAY + timedelta(hours=1), True)], [(97, DAY + timedelta(hours=2), True)]], "feedback_id long, response_ts timestamp, ok boolean", tmp_path / "r", 3)
    got = {r.feedback_id: r.enrichment_status for r in run(spark, S.stream_enrich_status(fb, rs), "status_out", tmp_path)}
    assert {k: got[k] for k in (1, 2, 3)} == {1: "completed", 2: "failed", 3: "timeout"}


ROUTED = "feedback_id long, cluster_id long, customer_id long, ts timestamp, account_type string, source_type string, engagement int, text string, theme_primary string, intent string, priority_level string, requires_action boolean, duplicate_count int"


def test_routing(spark, tmp_path):
    """Later batches see the tickets of earlier ones; a replayed batch changes nothing."""
    rng = random.Random(2)
    rows = [
        (i, rng.choice([None, 1, 2, 3, 4]), i % 5, DAY + timedelta(minutes=i // 2), rng.choice(["basic", "high_value"]), "direct", 0, rng.choice(["ok", "my lawyer"] + ["fine"] * 6), "billing", rng.choice(["complaint", "praise", "request_for_help"]), rng.choice(["low", "medium", "high"]), rng.random() < 0.4, 0)
        for i in range(120)
    ]
    tickets = spark.createDataFrame([(7, "new", "Retention", DAY - timedelta(days=9), 2), (8, "closed", "Retention", DAY, 3)], "ticket_id long, ticket_phase string, assigned_department string, updated_at timestamp, linked_cluster_id long")
    links = spark.createDataFrame([(k, 7) for k in (0, 5, 10)], "feedback_id long, ticket_id long")
    batch = spark.createDataFrame(rows, ROUTED)
    parts = [rows[k : k + 30] for k in range(0, 120, 30)]
    sink = Sink()
    S.stream_routing(files(spark, parts, ROUTED, tmp_path / "in", 4), tickets, links, batch, sink, str(tmp_path / "state")).awaitTermination(300)
    columns = ["routing_action", "linked_ticket_id", "new_ticket_id", "department", "resolution_type"]
    want = {r.feedback_id: [r[c] for c in columns] for r in routing_decision(batch, tickets, links).collect()}
    assert len(sink.batches) == 4 and {r["feedback_id"]: [r[c] for c in columns] for r in sink.rows} == want
    state = Versions(spark, f"{tmp_path}/state/tickets", S.TICKETS, ["ticket_id"])
    before = sorted(map(tuple, state.before(4).collect()))
    # the third batch once more, as after a failure
    again, opened = G.routing_decision(spark.createDataFrame(parts[2], ROUTED), S.known_tickets(tickets, state, 2), open_links=G.customer_open_tickets(tickets, links, batch)), Sink()
    opened(again, 2)
    assert sorted(map(str, opened.rows)) == sorted(map(str, sink.batches[2]))
    state.write(S.opened_tickets(again, spark.createDataFrame(parts[2], ROUTED)), 2)
    assert sorted(map(tuple, state.before(4).collect())) == before


def test_a_step_of_life_asks_its_state_once():
    """A call of the state store or of pandas' grouping for each key is what a trigger takes."""
    import pandas as pd

    from feedloom.streaming.lifecycle import Lifecycle

    asked = []

    class Handle:
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *a: asked.append(name)

    life = Lifecycle(1, 2)
    life.init(Handle())
    at = lambda d: pd.Timestamp(DAY + timedelta(days=d))
    got = pd.concat(life.handleInputRows((7,), iter([pd.DataFrame({"ts": [at(4), at(0.5), at(0)]}), pd.DataFrame({"ts": [at(0.2)]})]), None))
    assert [(r.cluster_id, r.status, r.at.tz_localize(None)) for r in got.itertuples()] == [(7, "active", at(0)), (7, "monitoring", at(1.5)), (7, "resolved", at(2.5))]
    assert asked == ["get", "update"]


def test_leading_tickets_say_what_all_do(spark):
    rng = random.Random(8)
    rows = [(str(i), rng.choice(["new", "resolved", "closed", "in_progress", None]), rng.choice(["a", "b", None]), rng.choice([None, DAY, DAY + timedelta(days=1)]), rng.choice([None, 1, 2, i]), rng.choice([None, *range(40)])) for i in range(150)]
    tickets = spark.createDataFrame(rows, S.TICKETS)
    leading = G.leading_tickets(tickets)
    assert sorted(map(str, G.cluster_ticket_state(leading).collect())) == sorted(map(str, G.cluster_ticket_state(tickets).collect()))
    half = G.leading_tickets(tickets.where("ticket_id < '5'")).unionByName(tickets.where("ticket_id >= '5'").select(leading.columns))
    assert sorted(map(str, G.cluster_ticket_state(half).collect())) == sorted(map(str, G.cluster_ticket_state(tickets).collect()))
