"""Scopes of cards: filter, rank, shadowing by key, and the session's baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

#: What a scope rank adds to a score: branch, repo, language; a global scope adds nothing.
BOOST = {3: 0.012, 2: 0.008, 1: 0.004}
HIDDEN = ("candidate", "retired")


# Files that tell a repository's languages, in the order in which these are listed.
MANIFESTS = (
    ("go.mod", "go"), ("tsconfig.json", "typescript"), ("package.json", "javascript"), ("pyproject.toml", "python"), ("requirements.txt", "python"),
    ("Cargo.toml", "rust"), ("Gemfile", "ruby"), ("composer.json", "php"), ("pom.xml", "java"), ("build.gradle", "java"),
)
#: Directories above a path, itself included, that are searched for a repository.
LEVELS = 24


def branch_of(head: Column) -> Column:
    """The branch that a HEAD file names, or the first eight digits of a commit; empty if it tells neither."""
    head = F.trim(head, F.lit(" \t\r\n"))
    ref = F.regexp_replace(F.substr(head, F.lit(6)), "^refs/heads/", "")
    return F.when(F.startswith(head, F.lit("ref: ")), ref).when(F.octet_length(head) >= 8, F.substring(head, 1, 8)).otherwise("")


def detected(paths: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(cwd, repo, branch, langs, allowed) of each path: the scopes of the nearest repository at or above it.

    roots: root, head (the text of HEAD); files: root, file, of which only manifests count. A path is exploded into itself and
    the directories above it, 24 at most, and equi-joined with the roots; the longest wins. Outside a repository a path's
    scopes are global and `dir:` with eight hex digits of its hash.
    """
    cwds = paths.select("cwd").distinct()
    parts = F.split("cwd", "/")
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(LEVELS - 1))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    spread = cwds.select("cwd", F.posexplode(above).alias("up", "root")).withColumn("root", F.when((F.col("root") == "") & F.startswith("cwd", F.lit("/")), "/").otherwise(F.col("root")))
    near = spread.join(roots.select("root", F.coalesce("head", F.lit("")).alias("head")), "root").groupBy("cwd").agg(F.min_by(F.struct("root", "head"), "up").alias("r")).select("cwd", "r.*")
    known = F.create_map(*(F.lit(x) for k, (file, _) in enumerate(MANIFESTS) for x in (file, k)))
    nth = files.select("root", F.element_at(known, F.col("file")).alias("k")).where("k is not null")
    names = F.array(*(F.lit(lang) for _, lang in MANIFESTS))
    langs = nth.groupBy("root").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.get(names, k))).alias("langs"))
    rows = cwds.join(near, "cwd", "left").join(langs, "root", "left").withColumn("langs", F.coalesce("langs", F.array().cast("array<string>")))
    repo = F.element_at(F.split("root", "/"), -1)
    rows = rows.withColumn("repo", F.coalesce(repo, F.lit(""))).withColumn("branch", F.coalesce(branch_of(F.col("head")), F.lit("")))
    one = lambda c, when: F.when(when, F.array(c)).otherwise(F.array().cast("array<string>"))
    inside = F.concat(
        F.array(F.lit("global"), F.concat(F.lit("repo:"), "repo")), one(F.concat(F.lit("branch:"), "repo", F.lit("@"), "branch"), F.col("branch") != ""),
        F.transform("langs", lambda x: F.concat(F.lit("lang:"), x)),
    )
    outside = F.array(F.lit("global"), F.concat(F.lit("dir:"), t.short_hash(F.col("cwd"), 8)))
    return rows.select("cwd", "repo", "branch", "langs", F.when(F.col("root").isNull(), outside).otherwise(inside).alias("allowed"))


def scope_rank(scopes: Column, allowed: list[str]) -> Column:
    """Rank of the narrowest allowed scope (branch 3, repo 2, language 1, else 0); null if none is allowed."""
    rank = lambda s: F.when(s.startswith("branch:"), 3).when(s.startswith("repo:"), 2).when(s.startswith("lang:"), 1).otherwise(0)
    return F.array_max(F.transform(F.array_intersect(scopes, F.array(*map(F.lit, allowed))), rank))


def boost(rank: Column) -> Column:
    out = F.when(rank == 3, BOOST[3])
    for k in (2, 1):
        out = out.when(rank == k, BOOST[k])
    return out.otherwise(0.0)


def in_scope(cards: DataFrame, allowed: list[str]) -> DataFrame:
    """Live cards with an allowed scope, and their scope_rank."""
    rows = cards.where(~F.col("status").isin(*HIDDEN)).withColumn("scope_rank", scope_rank(F.col("scopes"), allowed))
    return rows.where("scope_rank is not null")


def unshadowed(cards: DataFrame) -> DataFrame:
    """Of the cards that share a key those of the narrowest scope; ties all stay, and so do cards without a key.

    The best rank of a key is an aggregate summed up before the shuffle, so a key of very many cards is no hot spot.
    """
    best = cards.where("key != ''").groupBy("key").agg(F.max("scope_rank").alias("best"))
    return cards.join(best, "key", "left").where("best is null or scope_rank = best").drop("best")


def baseline(cards: DataFrame, allowed: list[str]) -> DataFrame:
    """Baseline cards in scope, the narrowest first, with their place."""
    rows = in_scope(cards.where("baseline"), allowed)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("scope_rank"), "index_seq")))
