import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import pack, retrieve, scope

SCHEMA = "id string, type string, title string, summary string, body string, scopes array<string>, key string, status string, aliases array<string>, trig_kw array<string>, baseline boolean, index_seq long, vec array<float>"


def card(id_, title, summary, scopes=("global",), key="", kw=(), status="active", vec=None, n=0):
    return (id_, "rule", title, summary, f"body of {title}", list(scopes), key, status, [], list(kw), True, n, vec)


def found(spark, cards, query, allowed, vec=None, utility=None):
    rows = retrieve.retrieve(spark.createDataFrame(cards, SCHEMA), spark.createDataFrame([(1, query, vec)], "query_id long, query string, vec array<float>"), allowed, utility)
    return [r["id"] for r in rows.orderBy("place").collect()]


def test_shadowing(spark):
    cards = [card("global", "Commit style", "conventional commits everywhere", key="k"), card("repo", "Repo commit style", "conventional commits with ticket prefix", ["repo:x"], "k")]
    assert found(spark, cards, "what is the commit style convention?", ["global", "repo:x"]) == ["repo"]
    assert found(spark, cards, "what is the commit style convention?", ["global"]) == ["global"]


def test_shadowing_keeps_ties(spark):
    cards = spark.createDataFrame([card("a", "x", "y", ["repo:x"], "k"), card("b", "x", "y", ["repo:x"], "k"), card("c", "x", "y", key="k"), card("d", "x", "y")], SCHEMA)
    assert sorted(r["id"] for r in scope.unshadowed(scope.in_scope(cards, ["global", "repo:x"])).collect()) == ["a", "b", "d"]


def test_pin(spark):
    cards = [card("rebase", "Rebase rule", "never rebase shared branches", kw=["rebase"]), card("other", "Feature branch names", "name a feature branch well")]
    assert found(spark, cards, "should I rebase my feature branch today?", ["global"])[0] == "rebase"


def test_floor_and_scope(spark):
    assert found(spark, [card("deploy", "Deploy checklist", "run smoke tests before deploying to production")], "compose a haiku about autumn leaves", ["global"]) == []
    cards = [card("go", "Wrap errors", "how to wrap errors", ["lang:go"]), card("js", "Wrap errors", "how to wrap errors", ["lang:javascript"])]
    assert found(spark, cards, "how should I wrap errors here?", ["global", "lang:go"]) == ["go"]


def test_cosine_alone_passes_the_floor(spark):
    cards = [card("auth", "Sign in", "tokens", vec=[1.0, 0.0]), card("far", "Colours", "palette", vec=[0.0, 1.0])]
    assert found(spark, cards, "authenticate somebody please", ["global"], [1.0, 0.0]) == ["auth"]


def test_cosine_takes_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cards, queries = rng.normal(size=(60, 8)), rng.normal(size=(4200, 8))
    card_rows = spark.createDataFrame([*((f"c{i:02}", v.tolist()) for i, v in enumerate(cards)), ("none", None)], "id string, vec array<double>")
    query_rows = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(queries)), (-1, None)], "query_id long, vec array<double>")
    monkeypatch.setattr(retrieve, "CARD_SHARD", 25)
    found = {(r["query_id"], r["cosine_rank"]): r["id"] for r in retrieve.cosine_top(card_rows, query_rows, 3).collect()}
    order = np.argsort(-(queries @ cards.T), axis=1)[:, :3]
    assert found == {(i, k + 1): f"c{order[i, k]:02}" for i in range(4200) for k in range(3)}
    assert retrieve.cosine_top(card_rows.where("id = 'none'"), query_rows).count() == 0 and retrieve.cosine_top(card_rows, query_rows.where("query_id < 0")).count() == 0


def test_utility_flips_order(spark):
    cards = [card("a", "Error handling", "wrap errors with package prefix"), card("b", "Error handling", "wrap errors with package prefix")]
    use = spark.createDataFrame([("a", 0.5)], "card_id string, utility double")
    assert found(spark, cards, "how to wrap errors with package prefix", ["global"]) == ["a", "b"]
    assert found(spark, cards, "how to wrap errors with package prefix", ["global"], utility=use) == ["b", "a"]


def test_pin_cap(spark):
    rows = spark.createDataFrame([(1, c, s, True, 1, 1) for c, s in (("a", 0.1), ("b", 0.3), ("c", 0.2))] + [(1, "d", 0.105, False, 1, 1)], "query_id long, id string, score double, pinned boolean, bm25_rank int, cosine_rank int")
    out = retrieve.capped(rows).orderBy("place").collect()
    assert [(r["id"], r["pinned"]) for r in out] == [("b", True), ("c", True), ("a", False), ("d", False)]


def test_diverse_order():
    assert pack.diverse_order([0.030, 0.029, 0.020], [False] * 3, [[1, 0], [1, 0], [0, 1]]) == [0, 2, 1]
    assert pack.diverse_order([0.1, 0.2], [False] * 2, [None, None]) == [0, 1]
    assert pack.diverse_order([0.1, 0.2, 0.3], [False, True, False], [None] * 3) == [1, 2, 0]


def test_pack(spark):
    cols = "query_id long, id string, place int, score double, pinned boolean, vec array<float>, tok_body int, text_summary int, text_body int, tok_hook int"
    rows = spark.createDataFrame([(1, f"c{i}", i + 1, 1.0 - i / 10, False, None, 100, 50, 110, 10) for i in range(6)], cols)
    out = pack.pack(rows, 300).orderBy("place").collect()
    assert [(r["id"], r["granularity"], r["tokens"]) for r in out] == [("c0", "body", 110), ("c1", "summary", 50), ("c2", "summary", 50), ("c3", "summary", 50)]
    had = spark.createDataFrame([(1, "c0", 3), (1, "c1", 1)], "query_id long, id string, level int")
    assert [r["id"] for r in pack.pack(rows, 300, had).orderBy("place").collect()] == ["c1", "c2", "c3"]
    assert len(pack.pack(rows, 300, hooks=1).where("granularity = 'hook'").collect()) == 1


@pytest.mark.parametrize(("scopes", "rank"), [(["global"], 0), (["lang:go"], 1), (["repo:x"], 2), (["branch:x@y"], 3), (["global", "repo:x"], 2), (["repo:z"], None)])
def test_scope_rank(spark, scopes, rank):
    rows = spark.createDataFrame([(scopes,)], "s array<string>")
    assert rows.select(scope.scope_rank(F.col("s"), ["global", "lang:go", "repo:x", "branch:x@y"])).first()[0] == rank


def test_short_ids(spark):
    rows = spark.createDataFrame([(f"id{i}", i) for i in range(2000)], "id string, index_seq long")
    out = pack.short_ids(rows).collect()
    assert len({r["short_id"] for r in out}) == 2000 and min(len(r["short_id"]) for r in out) == 4
