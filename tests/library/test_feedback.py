import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, feedback, learning, lifecycle

NOW = dt.datetime(2024, 1, 29)
AGO = NOW - dt.timedelta(days=14)


def test_decay(spark):
    rows = spark.createDataFrame([("a", "expanded", 1.0, AGO), ("a", "expanded", 1.0, NOW), ("a", "downvoted", 2.0, NOW + dt.timedelta(days=1))], "card_id string, kind string, delta double, ts timestamp")
    r = feedback.decayed_stats(rows, F.lit(NOW)).first()
    assert (r["expanded"], r["downvoted"], r["injected"]) == (pytest.approx(1.5), 2.0, 0.0)


@pytest.mark.parametrize(
    ("stats", "usage", "bucket"),
    [
        ({}, (1, 300), "uncertain"), ({"expanded": 2}, (10, 500), "helpful"), ({"referenced": 1}, (4, 100), "helpful"), ({"expanded": 1, "downvoted": 1}, (6, 200), "noisy"),
        ({"downvoted": 0.3}, (5, 100), "noisy"), ({"expanded": 3, "downvoted": 1}, (20, 400), "helpful"), ({}, (12, 5000), "expensive"), ({}, (12, 300), "uncertain"), ({"injected": 8}, (0, 5000), "expensive"), ({"downvoted": 0.2}, (5, 100), "uncertain"),
    ],
)
def test_verdicts(spark, stats, usage, bucket):
    s = spark.createDataFrame([("a", *(float(stats.get(k, 0)) for k in feedback.KINDS))], "card_id string, injected double, expanded double, referenced double, downvoted double")
    u = spark.createDataFrame([("a", *usage)], "card_id string, injections long, tokens long")
    assert feedback.effectiveness(s, u).first()["bucket"] == bucket


def test_abandoned_pointers(spark):
    log = [("s", "a", "hook", NOW), ("s", "b", "hook", NOW), ("s", "b", "body", NOW), ("s", "c", "hook", NOW), ("t", "c", "summary", NOW), ("t", "a", "body", NOW)]
    rows = spark.createDataFrame(log, "session_id string, card_id string, granularity string, ts timestamp")
    assert sorted(tuple(r) for r in feedback.abandoned_pointers(rows).collect()) == [("s", "a"), ("s", "c")]  # what another session has counts nothing


def test_card_report(spark):
    log = [("claude:s1", "a", 40, "repo-a", "claude"), ("claude:s1", "a", 20, "repo-a", "claude"), ("codex:s2", "a", 30, "repo-a", "codex"), ("codex:s3", "b", 25, "repo-b", "codex"), ("codex:s3", "gone", 10, "repo-b", "codex")]
    rows = spark.createDataFrame([(s, c, n, w, h, "summary", "p", NOW) for s, c, n, w, h in log], "session_id string, card_id string, tokens int, cwd string, harness string, granularity string, event string, ts timestamp")
    cards = spark.createDataFrame([("a", "A", "active", 100, "rule"), ("b", "B", "active", 50, "rule")], "id string, title string, status string, tok_body int, type string")
    out = {r["card_id"]: r for r in analytics.card_report(rows, cards).collect()}
    assert (out["a"]["sessions"], out["a"]["deliveries"], out["a"]["harnesses"], out["a"]["tokens"]) == (2, 3, 2, 90)
    assert (out["gone"]["available"], out["gone"]["title"]) == (False, "gone")
    total = analytics.session_totals(rows).first()
    assert tuple(total) == (3, 5, 125)
    assert tuple(analytics.counterfactual(rows, cards).first())[:4] == (3, 450, 125, 325)


def test_spend_cap(spark):
    calls = spark.createDataFrame([(i, NOW + dt.timedelta(minutes=i), 0.4) for i in range(5)], "call_id int, ts timestamp, usd double")
    assert [r["allowed"] for r in learning.spend_cap(calls, 4, 1.0).orderBy("call_id").collect()] == [True, True, True, False, False]


def test_should_mine(spark):
    rows = spark.createDataFrame([(100, 0, 5.0, False), (100, 0, 0.0, True), (100, 100, 60.0, True), (20_000, 0, 11.0, False), (20_000, 0, 9.0, False)], "size long, o long, m double, final boolean")
    assert [r[0] for r in rows.select(learning.should_mine(F.col("size"), F.col("o"), F.col("m"), F.col("final"))).collect()] == [False, True, False, True, False]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime long, size long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime long, size long")
    assert {tuple(r) for r in lifecycle.sync_plan(new, old).collect()} == {("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")}
    assert sorted(r["path"] for r in lifecycle.upsert(old, new).collect()) == ["a", "b", "c", "d"]
    events = spark.createDataFrame([("a", "observe"), ("a", "observe"), ("b", "observe"), ("c", "confirm"), ("c", "retire")], "card_id string, kind string")
    assert {(r["card_id"], r["status"]) for r in lifecycle.card_states(events).collect()} == {("a", "active"), ("b", "candidate"), ("c", "retired")}
