import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import history

NOISY = ["go.sum", "a/yarn.lock", "Cargo.lock", ".npmrc", "home/.netrc", "x/.pypirc", "id_rsa", "k/id_ed25519", ".env", "a/.ENV.local", "Credentials.json", "secret.txt", "a/Secrets/../secrets.yml", "k.p12", "K.PFX", "a.keystore", "tls.pem", "b/tls.key", "vendor/x.go", "a/node_modules/b.js", "dist/a", "a/build/b", ".git/config", "src/{old => new}/a.py", "x.pb.go", "api/a_gen.go", "static/app.min.js"]
WORK = ["a.go", "cargo.lock.md", "target/a.rs", "app.js.map", "x.pb.go.txt", "a.MIN.js", "my-credentials.md", "docs/environment.md", "rebuild/a", "a/distance/b", "keys/a.txt"]


@pytest.mark.parametrize("paths,want", [(NOISY, True), (WORK, False)])
def test_noise(spark, paths, want):
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", history.noisy(F.col("path")).alias("noisy")).collect()
    assert [r["path"] for r in rows if r["noisy"] != want] == []


def test_any_lower_case_word_is_a_convention(spark):
    said = ["wip: a", "feat(x)!: b", "deps(a b): c", "Feat: d", "no colon", "two words: e", "fix:no blank"]
    commits = spark.createDataFrame([("r", str(i), i, x) for i, x in enumerate(said)] + [("q", str(i), i, "plain" if i else "fix: x") for i in range(4)], "repo string, sha string, time int, subject string")
    rows = {r["repo"]: r for r in history.conventions(commits).collect()}
    assert (rows["r"]["pct"], rows["r"]["style"]) == (42, "conventional") and [tuple(x) for x in rows["r"]["types"]] == [("deps", 1), ("feat", 1), ("wip", 1)]
    assert (rows["q"]["pct"], rows["q"]["style"], rows["q"]["types"]) == (25, "free", [])
    last = {r["repo"]: r for r in history.conventions(commits, last=3).collect()}
    assert (last["r"]["subjects"], last["r"]["pct"], last["q"]["pct"]) == (3, 0, 0)


def test_six_types_at_most_by_count_and_name(spark):
    said = [p for k, p in enumerate("hgfedcba") for _ in range(1 + k // 3)]
    commits = spark.createDataFrame([("r", str(i), i, f"{p}: x") for i, p in enumerate(said)], "repo string, sha string, time int, subject string")
    assert [tuple(x) for x in history.conventions(commits).first()["types"]] == [("a", 3), ("b", 3), ("c", 2), ("d", 2), ("e", 2), ("f", 1)]


MODULES = {"a.go": ".", "docs/a/b.md": "docs", "docs/b.md": "docs", "internal/x/a.go": "internal/x", "internal/a.go": "internal", "src/app/deep/a.ts": "src/app", "packages/ui/b": "packages/ui", "lib/src/a": "lib", " cmd/run/main.go ": "cmd/run", "  ": None}


def test_modules(spark):
    rows = spark.createDataFrame([(p,) for p in MODULES], "path string").select("path", history.module_dir(F.col("path")).alias("m")).collect()
    assert {r["path"]: r["m"] for r in rows} == MODULES


def test_churn_counts_lock_files_and_skips_renames(spark):
    files = [("r", "1", 1, "go.sum", 5, 1), ("r", "1", 1, "vendor/x/y.go", 2, 0), ("r", "2", 2, "vendor/z.go", 1, 1), ("r", "2", 2, "{a => internal}/q/b.go", 9, 9), ("r", "1", 1, "internal/q/b.go", 1, 0), ("r", "1", 1, "internal/q/c.go", 1, 0)]
    rows = spark.createDataFrame(files, "repo string, sha string, time long, path string, added long, deleted long")
    assert [tuple(r) for r in history.churn(rows).orderBy("module").collect()] == [("r", ".", 1, 6), ("r", "internal/q", 1, 2), ("r", "vendor", 2, 4)]
    assert [tuple(r) for r in history.churn(rows, last=1).collect()] == [("r", "vendor", 1, 2)]


def reachable(parents, tips):
    seen, open_ = set(), list(tips)
    while open_:
        if (x := open_.pop()) in parents and x not in seen:
            seen.add(x)
            open_ += parents[x]
    return seen


def test_ancestors_equal_a_plain_walk(spark):
    rng = random.Random(5)
    graph = {(repo, i): sorted({rng.randint(max(0, i - 9), i - 1) for _ in range(rng.choice((1, 1, 2, 3)))}, key=lambda _: rng.random()) if i else [] for repo in "ab" for i in range(120)}
    graph |= {("c", i): [i - 1] for i in range(300)}  # a long chain whose first parent isn't there
    commits = spark.createDataFrame([(r, str(i), [str(p) for p in ps]) for (r, i), ps in graph.items()], "repo string, sha string, parents array<string>")
    tips = [("a", 117), ("b", 60), ("b", 44), ("c", 250), ("c", 999)]
    got = {(r["repo"], int(r["sha"])) for r in history.ancestors(commits, spark.createDataFrame([(r, str(i)) for r, i in tips], "repo string, sha string")).collect()}
    want = {(r, x) for repo in "abc" for r, x in [(repo, y) for y in reachable({i: ps for (q, i), ps in graph.items() if q == repo}, [i for q, i in tips if q == repo])]}
    assert got == want and len(want) < len(graph)


def test_a_step_of_the_walk_joins_once(spark, monkeypatch):
    """A chain of 300 commits takes nine levels of jumps; no table that is written joins them all, or the driver would hold them all."""
    joins, write = [], history.written
    monkeypatch.setattr(history, "written", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or write(df))
    commits = spark.createDataFrame([("r", i, [i - 1]) for i in range(300)], "repo string, sha int, parents array<int>")
    assert history.ancestors(commits, commits.where("sha = 250").select("repo", "sha")).count() == 251
    assert len(joins) > 9 and max(joins) <= 2


def test_cards_of_unmerged_branches_are_retired(spark):
    commits = spark.createDataFrame([("w/app", "1", []), ("w/app", "2", ["1"]), ("w/app", "3", ["1"]), ("w/app", "4", ["2", "3"]), ("w/app", "5", ["3"])], "repo string, sha string, parents array<string>")
    tips = "repo string, branch string, sha string"
    before = spark.createDataFrame([("w/app", "main", "2"), ("w/app", "merged", "3"), ("w/app", "dropped", "5"), ("w/app", "kept", "5"), ("w/old", "x", "9")], tips)
    now = spark.createDataFrame([("w/app", "main", "4"), ("w/app", "kept", "5")], tips)
    lost = history.lost_branches(before, now, commits, spark.createDataFrame([("w/app", "4")], "repo string, sha string"))
    assert sorted((r["repo"], r["branch"]) for r in lost.collect()) == [("w/app", "dropped"), ("w/old", "x")]
    cards = [("a", ["branch:app@dropped"], "confirmed", "learn"), ("b", ["branch:app@dropped", "global"], "active", ""), ("c", ["branch:app@merged"], "confirmed", "learn"), ("d", [], "candidate", "learn")]
    left = history.without_lost(spark.createDataFrame(cards, "id string, scopes array<string>, status string, source string"), lost)
    assert {r["id"]: r["status"] for r in left.collect()} == {"a": "retired", "b": "active", "c": "confirmed", "d": "candidate"}


def test_idle_branches_cost_nothing(spark):
    outcomes = ["idle", "mined", "failed", "mined", "idle", "mined", "mined", "idle", "mined"]
    rows = [("r", f"b{i}", str(i), o) for i, o in enumerate(outcomes)] + [("q", "a", "1", "mined"), ("q", "b", "2", "stopped"), ("q", "c", "3", "idle")]
    got = {(r["repo"], r["branch"]): r["advances"] for r in history.mined_tips(spark.createDataFrame(rows, "repo string, branch string, sha string, outcome string")).collect()}
    assert got == {("r", "b0"): True, ("r", "b1"): True, ("r", "b2"): False, ("r", "b3"): True, ("r", "b4"): True, ("r", "b5"): True, ("r", "b6"): True, ("q", "a"): True, ("q", "b"): False}
