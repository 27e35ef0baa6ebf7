"""Best matches and smallest overlaps against brute force, where copies and common words or lines abound."""

import random
from itertools import combinations
from pathlib import Path

from pyspark.sql import functions as F

from corvane.functions.storage import shared_folder
from corvane.operators import bm25, history, learning
from corvane.plans import adapters

WORDS = ["lantern", "harbour", "violet", "granite", "meadow", "copper", "saffron", "willow", "thunder", "marble", "anchor", "ribbon"]


def overlap(x, y):
    return len(x & y) / len(x | y) if x and y else 0.0


def test_best_match_by_brute_force(spark):
    rng = random.Random(11)
    sets = [set(rng.sample(WORDS, rng.randint(0, 7))) for _ in range(60)]
    rows = [(f"c{i:03}", rng.choice("xy"), rng.choice(["candidate", "active", "retired"]), rng.choice(sets)) for i in range(150)]
    cards = spark.createDataFrame([(i, k, s, " ".join(sorted(w, key=lambda _: rng.random())), "") for i, k, s, w in rows], "id string, type string, status string, title string, summary string")
    want = {}
    for i, k, s, x in rows:
        if s == "candidate":
            first = min(((-round(overlap(x, y), 6), j) for j, l, r, y in rows if l == k and r != "retired" and j != i), default=(0, None))
            want[i] = (first[1], -first[0]) if -first[0] >= learning.JACCARD_NEAR else (None, None)
    got = {r["id"]: (r["match"], r["similarity"]) for r in learning.best_match(cards.where("status = 'candidate'"), cards).collect()}
    assert got == want and any(v[1] == 1.0 for v in want.values()) and any(v[0] is None for v in want.values())


def test_pairs_that_share_a_term_are_not_shuffled(spark):
    """The join's pairs go into a maximum of their set, not through a distinct."""
    cards = spark.createDataFrame([("a", "x", "candidate", "lantern violet", "")], "id string, type string, status string, title string, summary string")
    plan = learning.best_match(cards, cards)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan and "set#" in plan


def test_smallest_overlap_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 3)
    rng = random.Random(13)
    groups = {"apart": ([], 30), "dense": (["head"], 12), "two": (["head", "tail"], 9)}
    rows = [(f"r{i}", "k", g, tuple(dict.fromkeys(base + rng.sample(WORDS, rng.randint(1, 5))))) for g, (base, n) in groups.items() for i in range(n)]
    files = spark.createDataFrame([(r, k, g, "\n".join(x)) for r, k, g, x in rows], "repo string, kind string, name string, content string")
    got = {r["name"]: r for r in history.drift(files).collect()}
    for g in groups:
        forms = {x for _, _, n, x in rows if n == g}
        assert got[g]["class"] == "diverged" and got[g]["similarity"] == round(min(overlap(set(x), set(y)) for x, y in combinations(forms, 2)), 6)
    assert got["apart"]["similarity"] == 0 < got["dense"]["similarity"]


def test_disjoint_forms_make_no_pairs(spark):
    """Twenty thousand forms without a common line: two hundred million pairs, none of which is looked at."""
    forms = spark.range(20_000).select(F.lit("k").alias("kind"), F.lit("n").alias("name"), F.col("id").cast("string").alias("norm"), F.array(F.col("id").cast("string")).alias("lines"), F.lit(20_000).cast("long").alias("forms"))
    assert [tuple(r) for r in history.least_overlap(forms).collect()] == [("k", "n", 0.0)]


def test_scores_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SUMMED", 10)
    cards = spark.createDataFrame([(str(i), "lantern", "violet", "", [], []) for i in range(100)], "id string, title string, summary string, body string, aliases array<string>, trig_kw array<string>")
    queries = spark.createDataFrame([(1, "lantern"), (2, "violet lantern")], "query_id long, query string")
    scored = bm25.scores(cards, queries)
    assert "RepartitionByExpression [id" in (plan := scored._jdf.queryExecution().optimizedPlan().toString()) and "], 30" in plan and scored.count() == 200


def test_best_match_over_blocks_and_shards(spark, monkeypatch):
    """Sets and open candidates of several sizes in many tasks: as by brute force, and no row of the plan is a pair that shares a term."""
    monkeypatch.setattr(learning, "ASKED_BLOCK", 7)
    monkeypatch.setattr(learning, "SET_SHARD", 11)
    rng = random.Random(17)
    words = WORDS + [f"w{i}" for i in range(60)]
    bases = [rng.sample(words, rng.choice([1, 2, 5, 12, 25, 40])) for _ in range(40)]
    edited = lambda x: {w for w in x if rng.random() < 0.8} | set(rng.sample(words, rng.randint(0, 4)))
    rows = [(f"c{i:03}", rng.choice("xy"), rng.choice(["candidate", "active"]), edited(rng.choice(bases))) for i in range(300)]
    cards = spark.createDataFrame([(i, k, s, " ".join(sorted(w)), "") for i, k, s, w in rows], "id string, type string, status string, title string, summary string")
    want = {}
    for i, k, s, x in rows:
        if s == "candidate":
            first = min((-round(overlap(x, y), 6), j) for j, l, _, y in rows if l == k and j != i)
            want[i] = (first[1], -first[0]) if -first[0] >= learning.JACCARD_NEAR else (None, None)
    found = learning.best_match(cards.where("status = 'candidate'"), cards)
    assert {r["id"]: (r["match"], r["similarity"]) for r in found.collect()} == want and len({v[1] for v in want.values()}) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "posexplode" not in plan


def test_cosines_equal_in_six_digits_go_by_id(spark):
    """0.9999998 is no nearer than 0.9999996 to one who reads six digits."""
    rows = [("a", [1.0, 9e-4]), ("b", [1.0, 6e-4]), ("q", [1.0, 0.0])]
    unit = [(i, "x", "active", [x / (x * x + y * y) ** 0.5, y / (x * x + y * y) ** 0.5]) for i, (x, y) in rows]
    cards = spark.createDataFrame(unit, "id string, type string, status string, vec array<double>")
    assert [tuple(r) for r in learning.semantic_match(cards.where("id = 'q'"), cards).collect()] == [("q", "a", 1.0)]


def test_drift_moves_digests_not_lines(spark):
    """What is written for later steps is small beside the lines, however long they are."""
    rng = random.Random(19)
    size = lambda: sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2000)) for _ in range(1000)]
    forms = [[lines[0], *lines[i * 16 : i * 16 + 16]] for i in range(60)]
    files = spark.createDataFrame([(f"r{i:02}", "k", "n", "\n".join(x)) for i, x in enumerate(forms)], "repo string, kind string, name string, content string")
    before = size()
    assert [tuple(r)[2:] for r in history.drift(files).collect()] == [(60, "diverged", "r01", round(1 / 33, 6))]
    assert size() - before < sum(map(len, lines)) / 4


def test_drift_of_artifacts_without_a_kind(spark):
    files = spark.createDataFrame([("a", None, "n", "x\ny"), ("b", None, "n", "x"), ("c", "k", None, "x\ny"), ("d", "k", None, "z")], "repo string, kind string, name string, content string")
    assert {(r["kind"], r["class"], r["canonical"]) for r in history.drift(files).collect()} == {(None, "superset", "a"), ("k", "diverged", "c")}


def test_cards_join_without_whole_texts(spark, sf):
    """A query for titles joins titles to labels, not texts."""
    plan = adapters.cards(spark, sf).select("id", "title", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan[plan.index("Join") :]
