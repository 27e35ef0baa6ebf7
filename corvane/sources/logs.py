"""Readers of plain logs: skipped prompts, `git log --numstat`, style ledgers, dependency manifests, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

LEDGER = "struct<ts:timestamp,session_id:string,repo:string,dimension:string,observation:string,evidence:string>"
LAST_ROWS, DEPENDENCIES = 500, 20


def gate_skips(lines: DataFrame) -> DataFrame:
    """(reason, n) of log lines that say `gate skip (reason)`."""
    return lines.select(F.regexp_extract("value", r"gate skip \(([^)]+)\)", 1).alias("reason")).where("reason != ''").groupBy("reason").agg(F.count("*").alias("n"))


def numstat(lines: DataFrame) -> DataFrame:
    """(repo, sha, time, subject, path, added, deleted) of (repo, line_no, value): `@sha|time|subject` lines and their files.

    The commit of a file is the last one above it, in the log of one repository.
    """
    head = r"^@([0-9a-f]+)\|([0-9]+)\|(.*)$"
    order = Window.partitionBy("repo").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    commit = F.when(F.col("value").rlike(head), F.struct(F.regexp_extract("value", head, 1).alias("sha"), F.regexp_extract("value", head, 2).cast("long").alias("time"), F.regexp_extract("value", head, 3).alias("subject")))
    rows = lines.withColumn("c", F.last(commit, ignorenulls=True).over(order))
    file = r"^([0-9]+|-)\t([0-9]+|-)\t(.+)$"
    number = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract(value, '^([0-9]+|-)\\\\t([0-9]+|-)\\\\t', {k}) as bigint)"), F.lit(0))
    return rows.where(F.col("value").rlike(file) & F.col("c").isNotNull()).select("repo", "c.*", F.regexp_extract("value", file, 3).alias("path"), number(1).alias("added"), number(2).alias("deleted"))


def ledger_rows(lines: DataFrame) -> DataFrame:
    """Rows of a JSONL ledger of (line_no, value) that tell an observation; others, and lines that are no JSON, are skipped."""
    rows = lines.select("line_no", F.from_json("value", LEDGER).alias("x")).where(r"x.observation rlike '[^\\s\\x85\\p{Z}]'")
    words = [F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c) for c in ("session_id", "repo", "dimension", "observation", "evidence")]
    return rows.select("line_no", "x.ts", *words)


def style_ledger(lines: DataFrame, last: int = LAST_ROWS) -> DataFrame:
    """The last rows of a ledger that tell an observation."""
    return ledger_rows(lines).orderBy(F.desc("line_no")).limit(last)


def ledger_total(lines: DataFrame) -> DataFrame:
    """(total): all rows that tell an observation; what the trigger of a synthesis counts."""
    return ledger_rows(lines).agg(F.count("*").alias("total"))


def dependencies(manifest: Column, name: Column) -> Column:
    """Names that a go.mod, package.json or requirements.txt asks for, twenty at most."""
    go = F.regexp_extract_all(manifest, F.lit(r"(?m)^(?:require\s+)?\s*([\w.-]+\.[\w.-]+/[\w./~-]+)\s+v[0-9]"), F.lit(1))
    node = F.map_keys(F.from_json(F.get_json_object(manifest, "$.dependencies"), "map<string,string>"))
    pip = F.regexp_extract_all(manifest, F.lit(r"(?m)^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:[=<>!~;]|$)"), F.lit(1))
    found = F.when(name == "go.mod", go).when(name == "package.json", F.coalesce(node, F.array().cast("array<string>"))).when(name == "requirements.txt", pip)
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, DEPENDENCIES)


def make_targets(makefile: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(makefile, F.lit(r"(?m)^([A-Za-z][\w-]*):(?!=)"), F.lit(1)))


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.trim("value") != "").alias("n"))


def artifacts(files: DataFrame) -> DataFrame:
    """(repo, kind, name, path, content, description) of (repo, path, content): agents, skills and guidance of repositories."""
    agent, skill = r"(?:^|/)\.[a-z]+/agents/([^/]+)\.md$", r"(?:^|/)skills/([^/]+)/SKILL\.md$"
    kind = F.when(F.col("path").rlike(agent), "agent").when(F.col("path").rlike(skill), "skill").when(F.col("path").rlike(r"^(?:CLAUDE|AGENTS(?:\.override)?)\.md$"), "guidance")
    name = F.when(kind == "agent", F.regexp_extract("path", agent, 1)).when(kind == "skill", F.regexp_extract("path", skill, 1)).otherwise(F.regexp_replace("path", r"\.md$", ""))
    about = F.regexp_extract("content", r"(?m)^description:\s*[\"']?(.*?)[\"']?\s*$", 1)
    return files.withColumn("kind", kind).where("kind is not null").select("repo", "kind", name.alias("name"), "path", "content", about.alias("description"), t.short_hash(F.array_join(t.lines_of(F.col("content")), "\n"), 64).alias("norm_hash"))
