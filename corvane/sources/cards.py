"""Card files: Markdown with YAML front matter, read from a tree and rendered back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t

# Directories and the card types they hold.
TYPES = {"rules": "rule", "lessons": "lesson", "patterns": "pattern", "skills": "skill", "agents": "agent", "guides": "guide", "style": "style", "repos": "repo"}
FRONT = (
    "id string, type string, title string, summary string, scopes array<string>, key string, trig_kw array<string>, trig_glob array<string>, "
    "aliases array<string>, baseline boolean, status string, observations int, supersedes string, source string, model string, source_hash string, merged_from array<string>"
)


def card_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size, raw) of every *.md under `folder`, without hidden folders; under skills/ SKILL.md alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    path = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    rows = files.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("raw"))
    return rows.where(~F.col("path").rlike(r"(?:^|/)\.") & (~F.col("path").startswith("skills/") | F.col("path").rlike(r"(?:^|/)SKILL\.md$")))


def front_matter(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)


def body(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", ""), F.lit(" \t\r\n"))


def default_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/SKILL\.md$", ""), r"\.md$", "")


def default_type(path: Column) -> Column:
    top = F.substring_index(path, "/", 1)
    out = F.lit("note")
    for folder, kind in TYPES.items():
        out = F.when(top == folder, kind).otherwise(out)
    return out


def _yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def texts(x) -> list[str]:
        return [str(v) for v in x] if isinstance(x, list) else [] if x is None else [str(x)]

    def row(source: str) -> dict:
        try:
            d = yaml.safe_load(source) or {}
        except yaml.YAMLError:
            d = {}
        d = d if isinstance(d, dict) else {}
        trig, prov = d.get("triggers") or {}, d.get("provenance") or {}
        trig, prov = trig if isinstance(trig, dict) else {}, prov if isinstance(prov, dict) else {}
        word = lambda k, of=d: "" if of.get(k) is None else str(of[k])
        return {
            "id": word("id"), "type": word("type"), "title": word("title"), "summary": word("summary"), "scopes": texts(d.get("scope")), "key": word("key"),
            "trig_kw": texts(trig.get("keywords")), "trig_glob": texts(trig.get("globs")), "aliases": texts(d.get("aliases")), "baseline": d.get("baseline") is True, "status": word("status"),
            "observations": d.get("observations") if isinstance(d.get("observations"), int) else 0, "supersedes": word("supersedes"), "source": word("source", prov), "model": word("model", prov),
            "source_hash": word("source_hash", prov), "merged_from": texts(prov.get("merged_from")),
        }

    for batch in batches:
        front = pd.DataFrame([row(x or "") for x in batch["front"]], index=batch.index)
        yield pd.concat([batch.drop(columns="front"), front], axis=1)


def read_cards(files: DataFrame) -> DataFrame:
    """Cards of (path, mtime, size, raw). A file without a title is no card; what it doesn't say follows from its place."""
    rows = files.select("path", "mtime", "size", F.sha2("raw", 256).alias("content_hash"), body(F.col("raw")).alias("body"), front_matter(F.col("raw")).alias("front"))
    parsed = rows.mapInPandas(_yaml, "path string, mtime long, size long, content_hash string, body string, " + FRONT).where("title != ''")
    given = lambda name, other: F.when(F.col(name) == "", other).otherwise(F.col(name))
    return parsed.withColumns(
        {
            "id": given("id", default_id(F.col("path"))),
            "type": given("type", default_type(F.col("path"))),
            "summary": given("summary", t.first_line(F.col("body"))),
            "status": given("status", F.lit("active")),
            "scopes": F.when(F.size("scopes") == 0, F.array(F.lit("global"))).otherwise(F.col("scopes")),
            "tok_summary": t.token_estimate(given("summary", t.first_line(F.col("body")))),
            "tok_body": t.token_estimate(F.col("body")),
        }
    )


def render_cards(cards: DataFrame) -> DataFrame:
    """(path, raw): cards as files; id and type are left out where they follow from the path."""
    quote = lambda c: F.to_json(F.struct(c.alias("x")))
    value = lambda c: F.regexp_extract(quote(c), r'(?s)^\{"x":(.*)\}$', 1)  # noqa: E731  JSON scalars and lists are YAML too
    line = lambda name, c, when: F.when(when, F.concat(F.lit(f"{name}: "), value(c), F.lit("\n"))).otherwise("")
    col = F.col
    head = F.concat(
        F.lit("---\n"), line("id", col("id"), col("id") != default_id(col("path"))), line("type", col("type"), col("type") != default_type(col("path"))), line("title", col("title"), F.lit(True)),
        line("scope", col("scopes"), F.lit(True)), line("summary", col("summary"), col("summary") != ""), line("key", col("key"), col("key") != ""), line("aliases", col("aliases"), F.size("aliases") > 0),
        F.when(F.size("trig_kw") + F.size("trig_glob") > 0, F.concat(F.lit("triggers: "), F.to_json(F.struct(col("trig_kw").alias("keywords"), col("trig_glob").alias("globs"))), F.lit("\n"))).otherwise(""),
        line("baseline", col("baseline"), col("baseline")), line("status", col("status"), col("status") != "active"), F.lit("---\n"),
    )
    return cards.select("path", F.concat(head, "body", F.lit("\n")).alias("raw"))
