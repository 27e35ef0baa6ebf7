"""The style synthesis step by step, and the session history with its facets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, synthesis
from corvane.sources import logs

NOW = "timestamp '2024-06-30 12:00:00'"
PROPOSAL = "base string, nth int, slug string, title string, summary string, markdown string, keywords array<string>, scope string, confidence double"


def proposal(nth, slug="table-tests", title="Prefer table tests", markdown="- Write them", scope="repo:phin", confidence=0.9, base="k"):
    return (base, nth, slug, title, "s", markdown, list("abcdefg"), scope, confidence)


@pytest.mark.parametrize(("total", "consumed", "days", "want"), [(5, 5, 30, False), (15, 0, 0, True), (14, 0, 0, False), (3, 0, 8, True), (3, 2, 7, True), (1, 0, None, True), (4, 5, 30, False), (20, 5, 1, True)])
def test_due(spark, total, consumed, days, want):
    last = F.lit(None).cast("timestamp") if days is None else F.expr(f"{NOW} - interval {days} days")
    assert spark.range(1).select(synthesis.due(F.lit(total), F.lit(consumed), last, F.expr(NOW))).first()[0] is want


def test_state_moves_on_where_a_base_runs(spark):
    totals = spark.createDataFrame([("a", 20), ("b", 3), ("c", 1)], "base string, total long")
    state = spark.createDataFrame([("a", 2, dt.datetime(2024, 6, 29)), ("b", 1, dt.datetime(2024, 6, 29))], "base string, consumed long, last_at timestamp")
    got = {r["base"]: (r["runs"], r["consumed"]) for r in synthesis.advanced(totals, state, F.expr(NOW)).collect()}
    assert got == {"a": (True, 20), "b": (False, 1), "c": (True, 1)}
    assert all(r["runs"] for r in synthesis.advanced(totals, state, F.expr(NOW), force=True).collect())


def merge(spark, cards, proposals, against=()):
    after, done = synthesis.merged(spark.createDataFrame(cards, synthesis.CARD), spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(list(against), "base string, id string"))
    return {r["id"]: r for r in after.collect()}, sorted((r["id"], r["action"]) for r in done.collect())


def test_create_reinforce_confirm(spark):
    cards, done = merge(spark, [], [proposal(1)])
    card = cards["styles/table-tests"]
    assert done == [("styles/table-tests", "created")] and (card["status"], card["observations"], card["source"], card["scopes"], card["keywords"]) == ("candidate", 1, "learn", ["repo:phin"], list("abcde"))
    again, done = merge(spark, [tuple(card)], [proposal(1, title="Other")])
    assert done == [("styles/table-tests", "confirmed"), ("styles/table-tests", "reinforced")] and (again["styles/table-tests"]["status"], again["styles/table-tests"]["title"]) == ("confirmed", "Prefer table tests")
    third, done = merge(spark, [tuple(again["styles/table-tests"])], [proposal(1)])
    assert done == [("styles/table-tests", "reinforced")] and third["styles/table-tests"]["observations"] == 3


def test_a_slug_twice_in_a_run(spark):
    cards, done = merge(spark, [], [proposal(2, slug="Table  tests!", title="B"), proposal(1, title="A")])
    assert (cards["styles/table-tests"]["title"], cards["styles/table-tests"]["status"], cards["styles/table-tests"]["observations"]) == ("A", "confirmed", 2)
    assert [a for _, a in done] == ["confirmed", "created", "reinforced"]


def test_what_stays_as_it_is(spark):
    have = [("k", "styles/a", "style", "t", "s", "b", ["repo:x"], [], "retired", 4, "learn"), ("k", "styles/b", "style", "t", "s", "b", ["repo:x"], [], "active", 0, "hand"), ("k", "styles/c", "style", "t", "s", "b", ["repo:x"], [], "confirmed", 2, "learn"), ("j", "styles/c", "style", "t", "s", "b", ["repo:x"], [], "confirmed", 2, "learn")]
    after, done = synthesis.merged(spark.createDataFrame(have, synthesis.CARD), spark.createDataFrame([proposal(1, "a"), proposal(2, "b"), proposal(3, "c")], PROPOSAL), spark.createDataFrame([("k", "styles/c"), ("k", "styles/b"), ("k", "gone")], "base string, id string"))
    got = {(r["base"], r["id"]): (r["status"], r["observations"]) for r in after.collect()}
    assert got == {("k", "styles/a"): ("retired", 4), ("k", "styles/b"): ("active", 0), ("k", "styles/c"): ("retired", 3), ("j", "styles/c"): ("confirmed", 2)}
    assert sorted((r["id"], r["action"]) for r in done.collect()) == [("styles/a", "skipped"), ("styles/b", "skipped"), ("styles/c", "reinforced"), ("styles/c", "retired")]


def test_invalid_proposals_count_among_the_first_five(spark):
    bad = [proposal(1, title=" "), proposal(2, markdown="\n"), proposal(3, confidence=0.59), proposal(4, scope="global"), proposal(5, slug="ok"), proposal(6, slug="late")]
    assert set(merge(spark, [], bad)[0]) == {"styles/ok"} and merge(spark, [], [proposal(1, scope="lang:")])[0] == {}


def test_ledger_keeps_rows_with_an_observation(spark):
    lines = ['{"session_id":"a","dimension":"tests","observation":"x"}', '{"observation":" \\t "}', "no json", '{"dimension":"d"}', '{"observation":"y","repo":"r"}', "", '{"observation":"z","dimension":null}']
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert [(r["line_no"], r["dimension"]) for r in logs.style_ledger(rows, 2).orderBy("line_no").collect()] == [(4, ""), (6, "")]
    assert logs.ledger_total(rows).first()["total"] == 3


def test_groups_are_shown_largest_first(spark):
    rows = [("k", i, "r", " Tests ", "ab"[i % 2], f"o{i}", "e" if i == 13 else "") for i in range(14)] + [("k", 20 + i, "r", "errors", "ab"[i % 2], "q", "") for i in range(3)] + [("k", 30 + i, "r", "naming", "a", "n", "") for i in range(9)]
    df = spark.createDataFrame(rows, "base string, line_no int, repo string, dimension string, session_id string, observation string, evidence string")
    first = "### repo=r dimension=tests (14 observations, 2 sessions)\n" + "".join(f"- [{'ab'[i % 2]}] o{i}{' (evidence: e)' if i == 13 else ''}\n" for i in range(2, 14)) + "\n"
    second = "### repo=r dimension=errors (3 observations, 2 sessions)\n- [a] q\n- [b] q\n- [a] q\n\n"
    assert synthesis.shown_groups(df).first()["text"] == first + second
    assert synthesis.shown_groups(df, len(first) + 10).first()["text"] == first + synthesis.FURTHER_GROUPS


def test_context_lines(spark):
    cards = [("k", f"lessons/{i}", "lesson", f"t{i}", "one\ntwo", "candidate" if i == 9 else "confirmed", i) for i in range(10)] + [("k", f"styles/{i:02d}", "style", "t", "", "retired" if i == 0 else "candidate", i) for i in range(13)]
    rows = synthesis.context_lines(spark.createDataFrame(cards, "base string, id string, type string, title string, summary string, status string, index_seq int")).orderBy("kind", "nth").collect()
    assert [r["line"] for r in rows if r["kind"] == "lesson"] == [f"- lessons/{i}: t{i} — one" for i in (8, 7, 6, 5, 4)]
    assert [r["line"] for r in rows if r["kind"] == "style"] == [f"- styles/{i:02d}: t" for i in range(1, 11)]


def test_options_ignore_the_filters(spark):
    at = lambda d: dt.datetime(2024, 6, d, 11)
    log = [("s1", "a", "e", 1, "/w/app", "claude", at(30)), ("s2", "a", "e", 2, "/w/app", "codex", at(28)), ("s3", "b", "e", 3, "/w/web", "codex", at(2)), ("s3", "b", "e", 3, "", "", at(1)), ("s4", "c", "e", 4, None, None, None)]
    rows = spark.createDataFrame(log, "session_id string, card_id string, event string, tokens int, cwd string, harness string, ts timestamp")
    assert {(r["facet"], r["value"]): r["n"] for r in analytics.facets(rows).collect()} == {("repo", "app"): 2, ("repo", "web"): 1, ("harness", "claude"): 1, ("harness", "codex"): 2}
    assert {(r["facet"], r["value"]) for r in analytics.facets(rows.limit(0)).collect()} == {("harness", "claude"), ("harness", "codex")}
    ids = lambda **f: [r["session_id"] for r in analytics.session_history(rows, F.expr(NOW), **f).orderBy("place").collect()]
    assert ids() == ["s1", "s2", "s3", "s4"] and ids(harness="nonsense") == ids(repo="") == ids(preset="ever") == ids()
    assert ids(harness="codex") == ["s2", "s3"] and ids(repo="app") == ["s1", "s2"] and ids(preset="7d") == ["s1", "s2"] and ids(preset="today") == ["s1"] and ids(repo="app", harness="codex", preset="30d") == ["s2"]
    judged = spark.createDataFrame([("a", "helpful"), ("b", "noisy")], "card_id string, bucket string")
    count = lambda **f: dict(map(tuple, analytics.verdict_counts(rows, judged, F.expr(NOW), days=60, **f).collect()))
    assert count() == {"helpful": 1, "noisy": 1} and count(harness="claude") == {"helpful": 1}
