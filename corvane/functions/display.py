"""Expressions of reports: evidence in card bodies, verbs of commit subjects, times and numbers for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs of the subjects of governance commits.
VERBS = ("learn", "confirm", "reject", "retire", "reinforce", "edit", "import", "merge", "style", "pattern", "export", "revert")


def evidence(body: Column) -> Column:
    """The first evidence line of a body, without its label; empty if there is none."""
    return F.trim(F.regexp_extract(body, r"(?m)^\*\*Evidence:\*\*[ \t]*(.*)$", 1))


def without_markers(body: Column) -> Column:
    """A body without its evidence and reinforcement lines."""
    return F.trim(F.regexp_replace(body, r"(?m)^\*\*(?:Evidence|Reinforced)[^\n]*\n?", ""), F.lit(" \t\r\n"))


def subject_parts(subject: Column) -> Column:
    """(action, detail) of a subject that begins with a known verb and a colon; else (``, subject)."""
    head = rf"^({'|'.join(VERBS)}): "
    action = F.regexp_extract(subject, head, 1)
    return F.struct(action.alias("action"), F.regexp_replace(subject, head, "").alias("detail"))


def owned_spans(text: Column, owner: str) -> Column:
    """The contents of the spans that `owner` marks by comments."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<!-- {owner}:begin[^>]*-->\n?(.*?)\n?<!-- {owner}:end -->"), F.lit(1))


def without_spans(text: Column, owner: str) -> Column:
    return F.regexp_replace(text, rf"(?s)<!-- {owner}:begin[^>]*-->.*?<!-- {owner}:end -->\n?", "")


def ago(ts: Column, now: Column) -> Column:
    """How long ago: now, minutes, hours or days."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(ts)) / 60)
    return (
        F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
    )


def percent(x: Column) -> Column:
    return F.concat(F.greatest(F.lit(0), F.floor(x + 0.5)).cast("string"), F.lit("%"))


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def short_list(ids: Column, most: int = 2) -> Column:
    """The first ids, and how many more there are."""
    rest = F.size(ids) - most
    return F.concat(F.array_join(F.slice(ids, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def tolerant_time(s: Column) -> Column:
    """A timestamp in either of the forms that logs have; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]X")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")))


def call_cost(prompt_tokens: Column, completion_tokens: Column, model: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Cost in dollars by the rates of a million tokens of the first model whose name is contained; the dearest otherwise."""
    dearest = max(rates.values())
    cost = lambda r: (prompt_tokens * r[0] + completion_tokens * r[1]) / 1e6
    out = cost(dearest)
    for name, rate in reversed(rates.items()):
        out = F.when(model.contains(name), cost(rate)).otherwise(out)
    return out
