"""Style cards from observations: when a synthesis is due, what it reads, and what its proposals do to the cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import learning, transcript

#: New rows from which a synthesis is due at once, days after which any are enough.
NEW_ROWS, DAYS = 15, 7
#: Proposals of a run that count, and the confidence and observations from which a card is written and confirmed.
CARDS, CONFIDENCE, CONFIRM_AT, KEYWORDS, SLUG = 5, 0.6, 2, 5, 48
#: Rows of a group and bytes of all groups that are shown; lines of context.
SHOWN, INPUT_BYTES, STYLE_LINES, LESSON_LINES = 12, 10 << 10, 10, 5
FURTHER_GROUPS = "(further groups truncated)\n"
CARD = "base string, id string, type string, title string, summary string, body string, scopes array<string>, keywords array<string>, status string, observations int, source string"


def due(total: Column, consumed: Column, last_at: Column, now: Column) -> Column:
    """Whether a synthesis should run: 15 new rows, or any and a week since the last; a base that never ran has waited long enough."""
    fresh = total - F.coalesce(consumed, F.lit(0))
    waited = last_at.isNull() | (F.unix_micros(now) - F.unix_micros(last_at) >= DAYS * 86_400_000_000)
    return (fresh > 0) & ((fresh >= NEW_ROWS) | waited)


def advanced(totals: DataFrame, state: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """(base, runs, consumed, last_at): which bases run, and the next state; those that run have consumed all of their rows.

    totals: base, total; state: base, consumed, last_at. The rows are consumed whether or not any group qualifies.
    """
    rows = totals.join(state, "base", "left")
    runs = F.lit(True) if force else due(F.col("total"), F.col("consumed"), F.col("last_at"), now)
    rows = rows.withColumn("runs", runs)
    return rows.select("base", "runs", F.when(F.col("runs"), F.col("total")).otherwise(F.coalesce("consumed", F.lit(0))).alias("consumed"), F.when(F.col("runs"), now).otherwise(F.col("last_at")).alias("last_at"))


def shown_groups(observations: DataFrame, most: int = INPUT_BYTES) -> DataFrame:
    """(base, text): what a synthesis reads of each base: its qualifying groups, the largest first, in at most `most` bytes.

    observations: base, line_no, repo, dimension, session_id, observation, evidence. A group has three rows or more of two
    sessions or more; the last twelve of it are shown.
    """
    rows = observations.withColumn("dimension", F.lower(F.trim("dimension")))
    groups = rows.groupBy("base", "repo", "dimension").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
    groups = groups.where((F.col("n") >= learning.GROUP_ROWS) & (F.col("sessions") >= learning.GROUP_SESSIONS))
    last = F.row_number().over(Window.partitionBy("base", "repo", "dimension").orderBy(F.desc("line_no")))
    shown = rows.withColumn("nth", last).where(F.col("nth") <= SHOWN)
    evidence = F.when(F.col("evidence") != "", F.concat(F.lit(" (evidence: "), "evidence", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- ["), "session_id", F.lit("] "), "observation", evidence, F.lit("\n"))
    lines = shown.groupBy("base", "repo", "dimension").agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"))
    head = F.format_string("### repo=%s dimension=%s (%d observations, %d sessions)\n", "repo", "dimension", "n", "sessions")
    section = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("\n"))
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), F.concat("repo", "dimension")))
    sections = groups.join(lines, ["base", "repo", "dimension"]).select("base", place.alias("place"), section.alias("section"))
    return transcript.byte_capped(sections, "base", "place", most, FURTHER_GROUPS)


def context_lines(cards: DataFrame) -> DataFrame:
    """(base, kind, nth, line) of what a model is told of a base: ten style cards by id, and the five newest confirmed lessons."""
    first = lambda *order: F.row_number().over(Window.partitionBy("base").orderBy(*order))
    styles = cards.where("type = 'style' and status != 'retired'").withColumn("nth", first("id")).where(F.col("nth") <= STYLE_LINES)
    lessons = cards.where("type = 'lesson' and status not in ('candidate', 'retired')").withColumn("nth", first(F.desc("index_seq"))).where(F.col("nth") <= LESSON_LINES)
    out = styles.select("base", F.lit("style").alias("kind"), "nth", F.concat(F.lit("- "), "id", F.lit(": "), "title").alias("line"))
    return out.unionByName(lessons.select("base", F.lit("lesson").alias("kind"), "nth", F.concat(F.lit("- "), "id", F.lit(": "), "title", F.lit(" — "), t.first_line(F.col("summary"))).alias("line")))


def valid(proposals: DataFrame) -> DataFrame:
    """The first five proposals of each base that have a title, a text, enough confidence and a repository or language for scope."""
    nth = F.row_number().over(Window.partitionBy("base").orderBy("nth"))
    rows = proposals.withColumn("_place", nth).where(F.col("_place") <= CARDS).drop("_place")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"[^\s\x85\p{Z}]")
    scope = (F.startswith("scope", F.lit("repo:")) | F.startswith("scope", F.lit("lang:"))) & (F.octet_length("scope") > 5)
    return rows.where(filled("title") & filled("markdown") & (F.col("confidence") >= CONFIDENCE) & scope)


def merged(cards: DataFrame, proposals: DataFrame, contradicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of `cards`, and (base, id, action) of what was done.

    cards: as CARD; proposals: base, nth, slug, title, summary, markdown, keywords, scope, confidence; contradicted: base, id.
    In the order of nth: a new slug creates a candidate with one observation; a slug that stands reinforces its card, if it
    was learnt and isn't retired, by one for each proposal, and a candidate with two observations is confirmed. So a
    slug proposed twice is created and reinforced in one run. Then contradicted cards that were learnt are retired; retired
    ones never come back. Actions are created, reinforced, confirmed, skipped and retired. One join for each step.
    """
    asked = valid(proposals).withColumn("id", F.concat(F.lit("styles/"), t.slug(F.col("slug"), SLUG, "style")))
    first = F.min_by(F.struct("title", "summary", "markdown", F.slice("keywords", 1, KEYWORDS).alias("keywords"), "scope"), "nth")
    asked = asked.groupBy("base", "id").agg(first.alias("p"), F.count("*").cast("int").alias("times"))
    out = contradicted.select("base", "id", F.lit(True).alias("against")).distinct()
    rows = cards.withColumn("_here", F.lit(True)).join(asked, ["base", "id"], "full_outer").join(out, ["base", "id"], "left")
    here, learnt = F.col("_here").isNotNull(), F.coalesce(F.col("source"), F.lit("")) == "learn"
    added = F.when(~here, F.col("times")).when(F.col("times").isNotNull() & learnt & (F.col("status") != "retired"), F.col("times")).otherwise(0)
    seen = F.coalesce("observations", F.lit(0)) + added
    was = F.when(here, F.col("status")).otherwise("candidate")
    grown = F.when(here, added > 0).otherwise(F.col("times") > 1)
    confirmed = grown & (was == "candidate") & (seen >= CONFIRM_AT)
    gone = F.coalesce("against", F.lit(False)) & (learnt | ~here)
    rows = rows.select(
        "base", "id", here.alias("here"), grown.alias("grown"), confirmed.alias("confirmed"), gone.alias("gone"),
        (here & F.col("times").isNotNull() & (added == 0)).alias("skipped"),
        F.when(here, F.col("type")).otherwise("style").alias("type"), F.when(here, F.col("title")).otherwise(_trim("p.title")).alias("title"),
        F.when(here, F.col("summary")).otherwise(_trim("p.summary")).alias("summary"), F.when(here, F.col("body")).otherwise(_trim("p.markdown")).alias("body"),
        F.when(here, F.col("scopes")).otherwise(F.array("p.scope")).alias("scopes"), F.when(here, F.col("keywords")).otherwise(F.col("p.keywords")).alias("keywords"),
        F.when(gone, "retired").when(confirmed, "confirmed").otherwise(was).alias("status"), seen.alias("observations"), F.when(here, F.col("source")).otherwise("learn").alias("source"),
    )
    one = lambda name, when: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    done = F.concat(one("created", ~F.col("here")), one("reinforced", F.col("grown")), one("confirmed", F.col("confirmed")), one("skipped", F.col("skipped")), one("retired", F.col("gone")))
    return rows.select(*(c.split()[0] for c in CARD.split(", "))), rows.select("base", "id", F.explode(done).alias("action"))


def _trim(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\A[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z", "")
