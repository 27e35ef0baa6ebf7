"""Change history: churn of modules, conventions of subjects, work units, branch tips, and drift of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions.storage import written

UNIT_GAP, UNITS, MODULES, CHURN_COMMITS = 48 * 3600, 3, 12, 500
#: Subjects that tell a repository's convention, types that are named, and the share in per cent from which it has one.
SUBJECTS, TYPES, CONVENTIONAL = 100, 6, 30
#: Forms of a cluster that a block holds, on average.
BLOCK = 1000
#: Branches with work that a run mines in a repository.
MINED = 4
# Paths that are no work (lock files, vendored or generated trees, renames) or may hold secrets, by the whole
# name, the start and end of the name in lower case, and the directory; and how a conventional subject begins.
NOISE_NAMES = (
    "go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "composer.lock",
    ".npmrc", ".netrc", ".pypirc", "id_rsa", "id_ed25519",
)
NOISE_STARTS = (".env", "credentials", "secret")
NOISE_ENDS = (".pem", ".key", ".p12", ".pfx", ".keystore")
NOISE_TAILS = (".pb.go", "_gen.go", ".min.js")  # of the name as it is written
NOISE_DIRS = ("vendor/", "node_modules/", "dist/", "build/", ".git/")
RENAME = "=>"
CONVENTION = r"^([a-z]+)(\([^)]*\))?!?: "
# Top directories whose own directories are modules.
UMBRELLAS = ("internal", "cmd", "pkg", "src", "apps", "packages")


def noisy(path: Column) -> Column:
    """A path that tells nothing of the work on a repository, or whose contents must never be quoted."""
    name = F.element_at(F.split(path, "/"), -1)
    lower = F.lower(name)
    out = path.contains(RENAME) | name.isin(*NOISE_NAMES)
    for test in (*(lower.startswith(x) for x in NOISE_STARTS), *(lower.endswith(x) for x in NOISE_ENDS), *(name.endswith(x) for x in NOISE_TAILS), *(F.concat(F.lit("/"), path).contains(f"/{x}") for x in NOISE_DIRS)):
        out = out | test
    return out


def module_dir(path: Column) -> Column:
    """The top directory of a path, with the next one below an umbrella; `.` for a file at the top, null for a blank path."""
    path = F.trim(path, F.lit(" \t\r\n"))
    parts = F.split(path, "/")
    deep = parts[0].isin(*UMBRELLAS) & (F.size(parts) > 2)
    return F.when(path == "", None).when(F.size(parts) == 1, ".").when(deep, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def churn(files: DataFrame, most: int = MODULES, last: int = CHURN_COMMITS) -> DataFrame:
    """(repo, module, commits, lines) of the modules with the most of the `last` commits; a commit counts once for a module.

    files: repo, sha, time, path, added, deleted; merges apart. Renames are left out, as they'd name a module that isn't there; lock files and vendored trees count.
    """
    recent = newest(files.select("repo", "sha", "time").distinct(), last, F.desc("time"), F.desc("sha")).select("repo", "sha")
    rows = files.join(recent, ["repo", "sha"], "left_semi").where(~F.contains("path", F.lit(RENAME))).withColumn("module", module_dir(F.col("path"))).where("module is not null")
    rows = rows.groupBy("repo", "module").agg(F.countDistinct("sha").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "module"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def newest(commits: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` commits of each repository by `order`: the best of hashed shares first, so that no task sorts a whole one."""
    share = F.pmod(F.xxhash64("sha"), F.lit(64))
    some = commits.withColumn("_nth", F.row_number().over(Window.partitionBy("repo", share).orderBy(*order))).where(F.col("_nth") <= most)
    return some.withColumn("_nth", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")


def conventions(commits: DataFrame, last: int = SUBJECTS) -> DataFrame:
    """(repo, subjects, pct, style, types) of the last subjects of each repository.

    commits: repo, sha, time, subject, without merges. pct is the share of conventional subjects in whole per cent; from 30 on
    the style is `conventional`, and `types` are its six commonest prefixes as (prefix, n), else it is `free` and has none.
    """
    rows = newest(commits, last, F.desc("time"), F.desc("sha")).withColumn("prefix", F.regexp_extract("subject", CONVENTION, 1))
    known = rows.where("prefix != ''").groupBy("repo", "prefix").agg(F.count("*").alias("n"))
    top = known.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "prefix"))).where(F.col("nth") <= TYPES)
    types = top.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "prefix", "n"))), lambda x: F.struct(x["prefix"].alias("prefix"), x["n"].alias("n"))).alias("types"))
    sums = rows.groupBy("repo").agg(F.count("*").alias("subjects"), F.expr("count_if(prefix != '') * 100 div count(*)").alias("pct")).join(types, "repo", "left")
    has = F.col("pct") >= CONVENTIONAL
    none = F.array().cast("array<struct<prefix:string,n:bigint>>")
    return sums.select("repo", "subjects", "pct", F.when(has, "conventional").otherwise("free").alias("style"), F.when(has, F.col("types")).otherwise(none).alias("types"))


def work_units(commits: DataFrame, gap: int = UNIT_GAP, most: int = UNITS) -> DataFrame:
    """(repo, branch, nth, n, start, end, dirs): the largest runs of commits that follow within two days and share a directory.

    commits: repo, branch, sha, time (seconds), dirs. Whatever its directories are, no unit reaches across a longer gap, so
    branches are cut there first; the fold then runs over one busy stretch of a branch, not over its whole history.
    """
    order = Window.partitionBy("repo", "branch").orderBy("time", "sha")
    cut = F.coalesce(F.col("time") - F.lag("time").over(order) > gap, F.lit(True)).cast("long")
    stretches = commits.where(F.size("dirs") > 0).withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = stretches.groupBy("repo", "branch", "stretch").agg(F.sort_array(F.collect_list(F.struct("time", "sha", "dirs"))).alias("c"))
    unit = "struct<start:bigint,end:bigint,n:int,dirs:array<string>>"
    state = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.lit(None).cast(unit).alias("open"))

    def begin(c: Column) -> Column:
        return F.struct(c["time"].cast("long").alias("start"), c["time"].cast("long").alias("end"), F.lit(1).alias("n"), c["dirs"].alias("dirs"))

    def step(acc: Column, c: Column) -> Column:
        joins = acc["open"].isNotNull() & (c["time"] - acc["open"]["end"] <= gap) & F.arrays_overlap(acc["open"]["dirs"], c["dirs"])
        grown = F.struct(acc["open"]["start"].alias("start"), c["time"].cast("long").alias("end"), (acc["open"]["n"] + 1).alias("n"), F.array_union(acc["open"]["dirs"], c["dirs"]).alias("dirs"))
        done = F.when(joins | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(begin(c)).alias("open"))

    units = ordered.select("repo", "branch", F.explode(F.aggregate("c", state, step, lambda a: F.concat(a["done"], F.array(a["open"])))).alias("u"))
    nth = F.row_number().over(Window.partitionBy("repo", "branch").orderBy(F.desc("u.n"), "u.start", F.array_sort("u.dirs")))
    rows = units.withColumn("nth", nth).where(F.col("nth") <= most)
    return rows.select("repo", "branch", "nth", "u.n", "u.start", "u.end", F.array_sort("u.dirs").alias("dirs"))


def tips_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(repo, branch, state): deleted, new, moved or unchanged tips."""
    a, b = before.select("repo", "branch", F.col("sha").alias("old")), now.select("repo", "branch", F.col("sha").alias("new"))
    state = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "moved").otherwise("unchanged")
    return a.join(b, ["repo", "branch"], "full_outer").select("repo", "branch", state.alias("state"))


def ancestors(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo, sha) of all commits that can be reached from `tips` (repo, sha), the tips too.

    commits: repo, sha, parents. First parents are followed by jumps that double (so a chain of n commits takes log n joins
    of narrow rows, whatever its length); the other parents of what is reached begin the next round, and rounds are as many
    as merges lie within merges. Each step of a round is a written table: a plan has one join with jumps, so at most one
    table at a time is broadcast, by its known size. Parents that are no commit of the repository end a chain.
    """
    known = commits.select("repo", "sha", "parents").dropDuplicates(["repo", "sha"])
    ids = known.select("repo", F.col("sha").alias("to"))
    level = written(known.select("repo", "sha", F.get("parents", F.lit(0)).alias("to")).join(ids, ["repo", "to"]).select("repo", "sha", "to"))
    jumps = []
    while not level.isEmpty():
        jumps.append(level)
        on = level.select("repo", F.col("sha").alias("to"), F.col("to").alias("far"))
        level = written(level.join(on, ["repo", "to"]).select("repo", "sha", F.col("far").alias("to")))
    sides = written(known.select("repo", "sha", F.explode(F.slice("parents", 2, 1 << 30)).alias("to")).join(ids, ["repo", "to"]).select("repo", "sha", "to"))
    reached, front = None, tips.select("repo", "sha").join(known.select("repo", "sha"), ["repo", "sha"], "left_semi").distinct()
    while True:
        new = written(front if reached is None else front.join(reached, ["repo", "sha"], "left_anti"))
        if new.isEmpty():
            return new if reached is None else reached
        for jump in reversed(jumps):
            far = jump.join(new.select("repo", "sha"), ["repo", "sha"]).select("repo", F.col("to").alias("sha"))
            new = written(new.unionByName(far).distinct())
        reached = new if reached is None else written(reached.unionByName(new).distinct())
        front = new.join(sides, ["repo", "sha"]).select("repo", F.col("to").alias("sha")).distinct()


def lost_branches(before: DataFrame, now: DataFrame, commits: DataFrame, base: DataFrame) -> DataFrame:
    """(repo, branch, sha) of deleted branches whose recorded tip isn't merged: no ancestor of the default branch's tip.

    base: repo, sha. In a repository without a default branch every deleted branch is lost.
    """
    gone = before.select("repo", "branch", "sha").join(now.select("repo", "branch"), ["repo", "branch"], "left_anti")
    return gone.join(ancestors(commits, base), ["repo", "sha"], "left_anti").select("repo", "branch", "sha")


def without_lost(cards: DataFrame, lost: DataFrame) -> DataFrame:
    """`cards` with those of a lost branch retired, if they were learnt; a card is of a branch by its scope `branch:<repo>@<branch>`."""
    scopes = lost.select(F.concat(F.lit("branch:"), F.element_at(F.split("repo", "/"), -1), F.lit("@"), "branch").alias("scope")).distinct()
    ids = cards.where("source = 'learn'").select("id", F.explode("scopes").alias("scope")).join(scopes, "scope").select(F.col("id").alias("_lost")).distinct()
    status = F.when(F.col("_lost").isNotNull(), "retired").otherwise(F.col("status"))
    return cards.join(ids, F.col("id") == F.col("_lost"), "left").select(*(status.alias(c) if c == "status" else F.col(c) for c in cards.columns))


def mined_tips(moved: DataFrame, most: int = MINED) -> DataFrame:
    """(repo, branch, sha, outcome, advances) of the branches that a run gets to, and whether their recorded tip advances.

    moved: repo, branch, sha, outcome (`mined`, `idle`, `failed` or `stopped`). Branches go by name. Only those with work use up
    the budget: a run ends once `most` are mined, or at the first that is stopped; idle branches advance and cost nothing,
    failed ones are tried again by the next run.
    """
    before = Window.partitionBy("repo").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    spent, stopped = F.coalesce(F.count_if(F.col("outcome") == "mined").over(before), F.lit(0)), F.coalesce(F.count_if(F.col("outcome") == "stopped").over(before), F.lit(0))
    rows = moved.withColumns({"spent": spent, "stopped": stopped}).where((F.col("spent") < most) & (F.col("stopped") == 0))
    return rows.select("repo", "branch", "sha", "outcome", F.col("outcome").isin("mined", "idle").alias("advances"))


def least_overlap(forms: DataFrame) -> DataFrame:
    """(kind, name, least): the smallest overlap of the lines of two forms of a cluster.

    forms: kind, name, norm, lines, and the number of `forms` of the cluster. A form whose lines have fewer other holders,
    all counted, than there are other forms is disjoint from one, so the least is 0 and no pair is looked at. Where every
    form may meet every other, the overlaps with the largest form give a bound, and only pairs whose lines in common to
    all forms leave them below it are compared, in blocks: their number may be square by nature, a task's memory isn't.
    """
    key = ["kind", "name"]
    lines = forms.select(*key, "norm", "forms", F.explode("lines").alias("line"))
    held = written(lines.groupBy(*key, "line", "forms").agg(F.count("*").alias("held")).where("held > 1"))
    met = lines.select(*key, "norm", "line").join(held, [*key, "line"]).groupBy(*key, "norm").agg(F.sum(F.col("held") - 1).alias("met"))
    lowest = forms.select(*key, "norm", "forms").join(met, [*key, "norm"], "left").groupBy(*key, "forms").agg(F.min(F.coalesce("met", F.lit(0))).alias("lowest"))
    apart = F.col("lowest") < F.col("forms") - 1
    lowest = written(lowest.select(*key, apart.alias("apart")))
    everywhere = held.where("held = forms").groupBy(*key).agg(F.count("*").alias("shared"))
    dense = forms.join(lowest.where("not apart").select(*key), key).join(everywhere, key, "left").fillna(0, ["shared"])
    dense = written(dense.withColumns({"n": F.size("lines"), "blocks": F.ceil(F.col("forms") / BLOCK).cast("int")}))
    largest = dense.groupBy(*key).agg(F.max_by(F.struct("norm", "lines"), F.struct("n", "norm")).alias("top"))
    bound = dense.join(largest, key).where(F.col("norm") != F.col("top.norm")).groupBy(*key).agg(F.min(t.jaccard(F.col("lines"), F.col("top.lines"))).alias("bound"))
    bound = written(bound)
    a = dense.join(bound, key).select(*key, "bound", "shared", F.col("norm").alias("m"), F.col("n").alias("p"), F.col("lines").alias("x"), F.pmod(F.xxhash64("norm"), F.col("blocks")).cast("int").alias("block"))
    b = dense.select(*key, F.col("norm").alias("o"), F.col("n").alias("q"), F.col("lines").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    below = F.col("shared") / (F.col("p") + F.col("q") - F.col("shared")) < F.col("bound")
    close = a.join(b, [*key, "block"]).where((F.col("m") < F.col("o")) & below).select(*key, t.jaccard(F.col("x"), F.col("y")).alias("least"))
    every = lowest.where("apart").select(*key, F.lit(0.0).alias("least")).unionByName(bound.select(*key, F.col("bound").alias("least"))).unionByName(close)
    return every.groupBy(*key).agg(F.min("least").alias("least"))


def digest(line: Column) -> Column:
    """144 bits of a line's SHA-256 as 24 characters: strings, as only those are hashed when arrays of them meet."""
    return F.substring(F.base64(F.unhex(F.sha2(line, 256))), 1, 24)


def drift(artifacts: DataFrame) -> DataFrame:
    """(kind, name, copies, class, canonical, similarity) of each cluster of copies.

    artifacts: repo, kind, name, content. A cluster is unique, identical (blank lines and trailing blanks aside),
    superset (one copy holds the lines of all others) or diverged, then with the smallest overlap of two copies. Contents
    are read once; what is shuffled from then on are digests of lines, and only those of clusters with several forms.
    """
    key = ["kind", "name"]
    told = lambda x: F.struct(F.size(F.array_distinct(x)).alias("n"), F.sha2(F.array_join(x, "\n"), 256).alias("norm"), F.array_distinct(F.transform(x, digest)).alias("lines"))
    rows = written(artifacts.select(*key, "repo", F.transform(F.array(t.lines_of(F.col("content"))), told)[0].alias("c")).select(*key, "repo", "c.*"))
    cluster = rows.groupBy(*key).agg(
        F.count("*").alias("copies"), F.countDistinct("norm").alias("forms"), F.min("repo").alias("first"), F.max("n").alias("most"), F.min_by("repo", F.struct(-F.col("n"), "repo")).alias("richest")
    )
    cluster = written(cluster)
    some = cluster.where("forms > 1").select(*(F.col(k).alias(f"_{k}") for k in key), "forms", "most")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name"))
    forms = written(rows.select(*key, "norm", "lines").join(some, same).drop("_kind", "_name").dropDuplicates([*key, "norm"]))
    union = forms.select(*key, "most", F.explode("lines").alias("line")).distinct().groupBy(*key, "most").agg(F.count("*").alias("all_lines"))
    whole = written(union.where("all_lines = most").select(*(F.col(k).alias(f"_{k}") for k in key), F.lit(True).alias("whole")))
    pairs = least_overlap(forms.drop("most").join(whole, same, "left_anti"))
    kind = F.when(F.col("copies") == 1, "unique").when(F.col("forms") == 1, "identical").when(F.col("whole"), "superset").otherwise("diverged")
    done = cluster.join(whole, same, "left").join(pairs, key, "left").withColumn("class", kind)
    canonical = F.when(F.col("class").isin("unique", "identical"), F.col("first")).otherwise(F.col("richest"))
    return done.select("kind", "name", "copies", "class", canonical.alias("canonical"), F.when(F.col("class") == "diverged", F.round("least", 6)).alias("similarity"))


def line_delta(a: Column, b: Column) -> tuple[Column, Column]:
    """Lines of b that a lacks, and of a that b lacks."""
    x, y = F.array_distinct(t.lines_of(a)), F.array_distinct(t.lines_of(b))
    return F.size(F.array_except(y, x)), F.size(F.array_except(x, y))
