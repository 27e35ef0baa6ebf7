"""Snapshots and their changes: sync plans, upserts, exports, missing vectors, states of cards from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.history import line_delta


def sync_plan(files: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action): insert, update, delete or keep, by the fingerprint of size and time."""
    a, b = files.select("path", F.struct("mtime", "size").alias("now")), state.select("path", F.struct("mtime", "size").alias("was"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.col("now") != F.col("was"), "update").otherwise("keep")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The next snapshot: `new` in place of the rows with its keys."""
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new)


def delete(existing: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti").select(existing.columns)


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first by `order`: earlier ids win, and repeated files are skipped."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def missing_vectors(cards: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Cards without a vector of this model and of their present content."""
    fresh = vectors.where(F.col("model") == model).select(F.col("card_id").alias("id"), "content_hash")
    return cards.join(fresh, ["id", "content_hash"], "left_anti").select("id")


def export_status(desired: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, status): what to do with each file, by its wanted, last written and present hash."""
    rows = desired.select("path", F.col("hash").alias("want")).join(manifest.select("path", F.col("hash").alias("wrote")), "path", "full_outer").join(disk.select("path", F.col("hash").alias("has")), "path", "full_outer")
    want, wrote, has = F.col("want"), F.col("wrote"), F.col("has")
    status = (
        F.when(want.isNull() & wrote.isNull(), "foreign").when(want.isNull() & (has.isNull() | (has == wrote)), "remove").when(want.isNull(), "edited")
        .when(has.isNull(), "write").when(has == want, "same").when(has == wrote, "write").otherwise("edited")
    )
    return rows.select("path", status.alias("status"))


def card_states(events: DataFrame, confirm_at: int = 2) -> DataFrame:
    """(card_id, observations, status) from events of kinds observe, confirm, reject and retire.

    A card is a candidate until it is confirmed or observed often enough; a rejected or retired one stays so.
    """
    count = lambda kind: F.count_if(F.col("kind") == kind)
    rows = events.groupBy("card_id").agg(count("observe").alias("observations"), count("confirm").alias("c"), count("reject").alias("r"), count("retire").alias("x"))
    status = F.when(F.col("x") + F.col("r") > 0, "retired").when((F.col("c") > 0) | (F.col("observations") >= confirm_at), "active").otherwise("candidate")
    return rows.select("card_id", "observations", status.alias("status"))


def stale_candidates(cards: DataFrame, now: Column, days: int) -> DataFrame:
    """Candidates untouched for longer than `days`; none if that is zero or less."""
    if days <= 0:
        return cards.limit(0)
    return cards.where((F.col("status") == "candidate") & (now - F.col("mtime") > days * 86_400 * 1_000_000_000))


def reset_session(injections: DataFrame, resets: DataFrame) -> DataFrame:
    """The log without rows of a session from before its last reset."""
    last = resets.groupBy("session_id").agg(F.max("ts").alias("reset_at"))
    return injections.join(last, "session_id", "left").where("reset_at is null or ts >= reset_at").drop("reset_at")


def retained(log: DataFrame, now: Column, days: int) -> DataFrame:
    """The rows of a log that are no older than `days`; rows without a time go."""
    return log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def staged_apply(staged: DataFrame, live: DataFrame, force: bool = False) -> DataFrame:
    """(path, outcome, added, removed): what applying reviewed files does, by path and content.

    Files under `residual/` are never applied. A live file with other content is a conflict, with the lines that the staged
    one adds and removes, unless `force`; equal content counts as applied.
    """
    rows = staged.select("path", F.col("content").alias("new")).join(live.select("path", F.col("content").alias("old")), "path", "left")
    clash = F.col("old").isNotNull() & (F.col("old") != F.col("new")) & F.lit(not force)
    outcome = F.when(F.startswith("path", F.lit("residual/")), "residual").when(clash, "conflict").otherwise("applied")
    added, removed = line_delta(F.col("old"), F.col("new"))
    rows = rows.withColumn("outcome", outcome)
    shown = F.col("outcome") == "conflict"
    return rows.select("path", "outcome", F.when(shown, added).alias("added"), F.when(shown, removed).alias("removed"))


def residuals(staged: DataFrame, repos: DataFrame, files: DataFrame, suffix: str = ".CLAUDE.md", name: str = "CLAUDE.md") -> DataFrame:
    """(path, repo, repo_path, missing) of staged residual files, with the watched repository of that base name, if any.

    repos: repo_path; files: path of the files that repositories have. Of repositories with one base name the last by path counts.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = staged.where(F.startswith("path", F.lit("residual/"))).select("path", base(F.col("path")).alias("repo"))
    rows = rows.withColumn("repo", F.when(F.endswith("repo", F.lit(suffix)), F.expr(f"left(repo, length(repo) - {len(suffix)})")).otherwise(F.col("repo")))
    known = repos.groupBy(base(F.col("repo_path")).alias("repo")).agg(F.max("repo_path").alias("repo_path"))
    have = files.where(F.endswith("path", F.lit("/" + name))).select(F.expr(f"left(path, length(path) - {len(name) + 1})").alias("repo_path"), F.lit(True).alias("has")).distinct()
    return rows.join(known, "repo", "left").join(have, "repo_path", "left").select("path", "repo", "repo_path", F.col("has").isNull().alias("missing"))


def by_reference(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """Cards that an `asked` (ref) names by id or by short id; an id wins over another card's equal short id.

    Each card is listed under both names, so the lookup is one equi-join.
    """
    names = cards.select("*", F.explode(F.array(F.struct(F.col("id").alias("ref"), F.lit(0).alias("by")), F.struct(F.col("short_id").alias("ref"), F.lit(1).alias("by")))).alias("_n"))
    found = names.select(F.col("_n.ref").alias("ref"), F.col("_n.by").alias("_by"), *cards.columns).join(asked.select(F.trim("ref").alias("ref")).distinct(), "ref")
    return found.withColumn("_nth", F.row_number().over(Window.partitionBy("ref").orderBy("_by", "id"))).where("_nth = 1").drop("_nth", "_by")


def moved_branches(before: DataFrame, now: DataFrame, base: str) -> DataFrame:
    """(repo, branch, sha): new and moved tips besides `base`; `history.mined_tips` tells which of them a run gets to."""
    old = before.select("repo", "branch", F.col("sha").alias("old"))
    return now.where(F.col("branch") != base).join(old, ["repo", "branch"], "left").where("old is null or old != sha").select("repo", "branch", "sha")
