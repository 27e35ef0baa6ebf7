"""Matches by vectors, running caps, references, residuals, retention and jobs, on small rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import analytics, bm25, feedback, learning, lifecycle


def test_bm25_equals_brute_force(spark):
    texts = {"a": ("alpha beta", "beta", "alpha alpha gamma"), "b": ("gamma", "", ""), "c": ("", "", ""), "d": ("beta", "delta beta", "beta " * 40)}
    rows = [(k, *v, [], ["beta"] if k == "b" else []) for k, v in texts.items()]
    cards = spark.createDataFrame(rows, "id string, title string, summary string, body string, aliases array<string>, trig_kw array<string>")
    queries = spark.createDataFrame([(1, "beta gamma"), (2, "alpha"), (3, "nothing"), (4, "")], "query_id long, query string")
    got = {(r["query_id"], r["id"]): r["bm25"] for r in bm25.scores(cards, queries).collect()}
    tf, dl = {}, {}
    for k, title, summary, body, _, extra in rows:
        tf[k] = Counter()
        for words, w in ((title, 4), (summary, 2), (body, 1), (" ".join(extra), 3)):
            for x in words.split():
                tf[k][x] += w
        dl[k] = len(" ".join((title, summary, body, *extra)).split())
    n, mean, want = len(rows), sum(dl.values()) / len(rows), {}
    for q, terms in ((1, ("beta", "gamma")), (2, ("alpha",))):
        for term in terms:
            df = sum(term in c for c in tf.values())
            for k in tf:
                if tf[k][term]:
                    part = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[k][term] * 2.2 / (tf[k][term] + 1.2 * (0.25 + 0.75 * dl[k] / mean))
                    want[q, k] = want.get((q, k), 0) + part
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_cards_give_no_scores(spark):
    cards = spark.createDataFrame([], "id string, title string, summary string, body string, aliases array<string>, trig_kw array<string>")
    assert bm25.top(bm25.scores(cards, spark.createDataFrame([(1, "beta")], "query_id long, query string"))).count() == 0


def test_vectors_judge_before_terms(spark):
    shape = "id string, type string, title string, summary string, status string, vec array<float>"
    have = [("h1", "rule", "one two three", "", "active", [1.0, 0.0]), ("h2", "rule", "four five six", "", "retired", [0.0, 1.0]), ("h3", "note", "seven eight nine", "", "active", None)]
    asked = [("c1", "rule", "x", "", "candidate", [0.95, 0.312]), ("c2", "rule", "x", "", "candidate", [0.0, 1.0]), ("c3", "rule", "one two three", "", "candidate", None), ("c4", "note", "seven eight nine", "", "candidate", [1.0, 0.0])]
    got = {r["id"]: (r["match"], r["verdict"], r["path"]) for r in learning.find_match(spark.createDataFrame(asked, shape), spark.createDataFrame(have, shape)).collect()}
    assert got == {"c1": ("h1", "dup", "cosine"), "c2": (None, "new", "cosine"), "c3": ("h1", "dup", "terms"), "c4": ("h3", "dup", "terms")}


def test_caps_run_over_minutes(spark):
    calls = [(f"c{i}", f"2024-01-01 00:{i // 4:02d}:{i % 4:02d}", 1.0) for i in range(12)] + [("d", "2024-01-02 00:00:00", None), ("e", None, 1.0), ("f", None, 1.0)]
    rows = spark.createDataFrame(calls, "call_id string, at string, usd double").select("call_id", F.to_timestamp("at").alias("ts"), "usd")
    allowed = {r["call_id"] for r in learning.spend_cap(rows, 100, 6.0).where("allowed").collect()}
    assert allowed == {f"c{i}" for i in range(6)} | {"d", "e", "f"}
    assert learning.spend_cap(rows, 5, 100.0).where("allowed").count() == 5 + 1 + 2


def test_references_by_either_id(spark):
    cards = spark.createDataFrame([("ab12", "ffff"), ("doc/2", "ab12"), ("doc/3", "0003")], "id string, short_id string")
    asked = spark.createDataFrame([("ab12",), (" 0003 ",), ("none",), ("doc/2",), ("doc/2",)], "ref string")
    assert sorted((r["ref"], r["id"]) for r in lifecycle.by_reference(cards, asked).collect()) == [("0003", "doc/3"), ("ab12", "ab12"), ("doc/2", "doc/2")]


def test_staged_files_and_residuals(spark):
    staged = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x\ny"), ("residual/app.CLAUDE.md", "r"), ("residual/gone.CLAUDE.md", "r")], "path string, content string")
    live = spark.createDataFrame([("b", "x"), ("c", "x\nz\nw")], "path string, content string")
    got = {r["path"]: tuple(r)[1:] for r in lifecycle.staged_apply(staged, live).collect()}
    assert got["a"] == got["b"] == ("applied", None, None) and got["c"] == ("conflict", 1, 2) and got["residual/app.CLAUDE.md"][0] == "residual"
    assert lifecycle.staged_apply(staged, live, force=True).where("outcome = 'conflict'").count() == 0
    repos = spark.createDataFrame([("/w/app",), ("/w/other",)], "repo_path string")
    found = lifecycle.residuals(staged, repos, spark.createDataFrame([("/w/app/CLAUDE.md",)], "path string")).collect()
    assert sorted((r["repo"], r["repo_path"], r["missing"]) for r in found) == [("app", "/w/app", False), ("gone", None, True)]


def test_retention_jobs_and_folding(spark):
    log = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-20"), ("c", None)], "id string, at string").select("id", F.to_timestamp("at").alias("ts"))
    assert [r["id"] for r in lifecycle.retained(log, F.expr("timestamp '2024-01-25'"), 10).collect()] == ["b"]
    jobs = spark.createDataFrame([(i, i % 3) for i in range(9)], "job_id int, created int")
    assert [r["job_id"] for r in analytics.newest_jobs(jobs, 2).collect()] == [2, 5] and analytics.newest_jobs(jobs, -1).count() == 9
    at = F.expr("timestamp '2024-01-01'")
    new = spark.createDataFrame([("a", "expanded", 1.0), ("b", "other", 1.0)], "card_id string, kind string, delta double").withColumn("ts", F.expr("timestamp '2024-01-15'"))
    old = spark.createDataFrame([("a", 0.0, 2.0, 0.0, None)], "card_id string, injected double, expanded double, referenced double, downvoted double")
    got = feedback.folded(old, at, new, F.expr("timestamp '2024-01-15'")).collect()
    assert [(r["card_id"], round(r["expanded"], 9), r["downvoted"]) for r in got] == [("a", 2.0, 0.0)]
