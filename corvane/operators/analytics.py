"""Delivery analytics over the append-only injection log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

SESSIONS, RECENT = 15, 500


def by_event(injections: DataFrame) -> DataFrame:
    return injections.groupBy("event", "granularity").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def session_totals(injections: DataFrame) -> DataFrame:
    return injections.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("deliveries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def daily_tokens(injections: DataFrame, days: int = 14) -> DataFrame:
    """(day, tokens) of the last `days` days that have deliveries."""
    rows = injections.groupBy(F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"))
    return rows.orderBy(F.desc("day")).limit(days)


def injected_levels(injections: DataFrame) -> DataFrame:
    """(session_id, card_id, level): the highest form of a card that a session has had."""
    level = F.when(F.col("granularity") == "body", 3).when(F.col("granularity") == "summary", 2).otherwise(1)
    return injections.groupBy("session_id", "card_id").agg(F.max(level).alias("level"))


def content_cards(injections: DataFrame) -> DataFrame:
    return injections.where("granularity != 'hook'").select("session_id", "card_id").distinct()


def card_report(injections: DataFrame, cards: DataFrame) -> DataFrame:
    """One row for each delivered card: sessions, deliveries, tokens, last use, repositories, and how many harnesses.

    Distinct counts come from two groupings that are summed up before each shuffle. A card that is gone has its id for a title.
    """
    fine = injections.groupBy("card_id", "session_id", "cwd", "harness").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("ts").alias("ts"))
    rows = fine.groupBy("card_id").agg(
        F.countDistinct("session_id").alias("sessions"), F.sum("n").alias("deliveries"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_used"),
        F.array_join(F.array_sort(F.collect_set("cwd")), ",").alias("repos"), F.countDistinct("harness").alias("harnesses"),
    )
    known = cards.select(F.col("id").alias("card_id"), "title")
    return rows.join(known, "card_id", "left").select("card_id", F.coalesce("title", "card_id").alias("title"), F.col("title").isNotNull().alias("available"), "sessions", "deliveries", "tokens", "last_used", "repos", "harnesses")


def card_harness_report(injections: DataFrame) -> DataFrame:
    return injections.groupBy("card_id", "harness").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("deliveries"), F.sum("tokens").alias("tokens"))


def counterfactual(injections: DataFrame, cards: DataFrame) -> DataFrame:
    """(sessions, dump, injected, saved, pct): what handing all live cards to every session had cost."""
    a = injections.agg(F.countDistinct("session_id").alias("sessions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("injected"), F.lit(1).alias("k"))
    b = cards.where("status not in ('candidate', 'retired')").agg(F.coalesce(F.sum("tok_body"), F.lit(0)).alias("corpus"), F.lit(1).alias("k"))
    rows = a.join(b, "k").withColumn("dump", F.col("sessions") * F.col("corpus")).withColumn("saved", F.col("dump") - F.col("injected"))
    return rows.select("sessions", "dump", "injected", "saved", F.when(F.col("dump") > 0, F.round(100.0 * F.col("saved") / F.col("dump"), 6)).otherwise(0.0).alias("pct"))


def card_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(F.col("status") == "retired").alias("retired"))


def stale_cards(cards: DataFrame, injections: DataFrame, stats: DataFrame) -> DataFrame:
    """Live cards that were never delivered and hardly ever used."""
    live = cards.where("status not in ('candidate', 'retired')").select("id")
    used = stats.where("expanded + referenced > 0.1").select(F.col("card_id").alias("id"))
    return live.join(injections.select(F.col("card_id").alias("id")).distinct(), "id", "left_anti").join(used, "id", "left_anti")


def recent_sessions(injections: DataFrame, newest: int = RECENT, most: int = SESSIONS) -> DataFrame:
    """The latest sessions among the newest rows, with totals, the last directory and the first harness that isn't empty."""
    order = [F.desc("ts"), "session_id", "event", "card_id", "tokens"]
    rows = injections.orderBy(*order).limit(newest)
    grouped = rows.groupBy("session_id").agg(
        F.max("ts").alias("last_ts"), F.count("*").alias("deliveries"), F.sum("tokens").alias("tokens"),
        F.max_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.struct("ts", "cwd"))).alias("cwd"),
        F.min_by(F.when(F.col("harness") != "", F.col("harness")), F.when(F.col("harness") != "", F.struct("ts", "harness"))).alias("harness"),
    )
    return grouped.orderBy(F.desc("last_ts"), "session_id").limit(most)


def granularity_mix(injections: DataFrame) -> DataFrame:
    """(body, summary, hook): shares in whole percent; the last is what is left."""
    n = F.count("*")
    part = lambda g: F.when(n > 0, F.floor(100.0 * F.count_if(F.col("granularity") == g) / n + 0.5)).otherwise(0)
    rows = injections.agg(part("body").alias("body"), part("summary").alias("summary"))
    return rows.withColumn("hook", F.greatest(F.lit(0), 100 - F.col("body") - F.col("summary")))


def spend(calls: DataFrame, today: Column) -> DataFrame:
    """(calls_today, usd_today, calls_week, usd_week)."""
    day = F.to_date("ts")
    now, week = day == today, (day <= today) & (day > F.date_sub(today, 7))
    total = lambda when, name: [F.count_if(when).alias(f"calls_{name}"), F.round(F.coalesce(F.sum(F.when(when, F.col("usd"))), F.lit(0.0)), 6).alias(f"usd_{name}")]
    return calls.agg(*total(now, "today"), *total(week, "week"))


def gate_skips(reasons: DataFrame) -> DataFrame:
    return reasons.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def trend(days: DataFrame) -> DataFrame:
    """(day, height): daily tokens as 6 to 100 of the largest day."""
    top = F.max("tokens").over(Window.partitionBy())
    return days.select("day", F.when(top > 0, F.floor(6 + 94.0 * F.col("tokens") / top + 0.5)).otherwise(6).cast("int").alias("height"))


def human(tokens: Column) -> Column:
    return t.human_tokens(tokens)


def top_scores(stats: DataFrame, score: Column, most: int = 3, least: float = 0.5) -> DataFrame:
    """(card_id, score): the best `most` cards that score `least` or more; ties by id."""
    rows = stats.select("card_id", F.round(score, 6).alias("score")).where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "card_id").limit(most)


def effectiveness_report(verdicts: DataFrame, usage: DataFrame) -> DataFrame:
    """(bucket, card_id, pull_rate, tokens) of judged cards, by bucket: by pull rate and tokens, expensive ones by tokens."""
    rows = verdicts.where("bucket != 'uncertain'").join(usage.select("card_id", "tokens"), "card_id", "left").fillna(0, ["tokens"])
    rate = F.when(F.col("bucket") == "expensive", 0.0).otherwise(F.col("pull_rate"))
    return rows.orderBy("bucket", F.desc(rate), F.desc("tokens"), "card_id").select("bucket", "card_id", "pull_rate", "tokens")


def cards_by_use(cards: DataFrame, stats: DataFrame, usage: DataFrame) -> DataFrame:
    """(id, index_seq, injected): all cards, the most delivered first, then as indexed."""
    rows = cards.select("id", "index_seq").join(stats.select(F.col("card_id").alias("id"), F.round("injected").cast("long").alias("a")), "id", "left")
    rows = rows.join(usage.select(F.col("card_id").alias("id"), F.col("injections").alias("b")), "id", "left")
    injected = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("injected")
    return rows.select("id", "index_seq", injected).orderBy(F.desc("injected"), "index_seq")


def review_queue(cards: DataFrame) -> DataFrame:
    """Candidates, the newest first."""
    return cards.where("status = 'candidate'").orderBy(F.desc("index_seq"))


def newest_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The newest `most` jobs; all if that is negative."""
    ordered = jobs.orderBy(F.desc("created"), "job_id")
    return ordered if most < 0 else ordered.limit(most)


# Presets of a time filter, in days before today or now; others mean no limit.
PRESETS = {"today": 0, "7d": 7, "30d": 30}
HARNESSES = ("claude", "codex")


def newest_rows(injections: DataFrame, most: int = RECENT) -> DataFrame:
    """The rows that a session history looks at: the newest of the log, whatever the filters (they come after)."""
    return injections.orderBy(F.desc("ts"), "session_id", "event", "card_id", "tokens").limit(most)


def since(preset: str, now: Column) -> Column | None:
    """Where a preset begins; None for all."""
    days = PRESETS.get(preset)
    return None if days is None else F.date_trunc("day", now) if days == 0 else now - F.make_dt_interval(F.lit(days))


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value, n): the options of the repository and harness filters, with the rows that each has.

    One scan gives both (grouping sets), before any filter: so choosing one option makes no other disappear. Rows without a
    repository or harness are no option; the known harnesses always are.
    """
    named = rows.select(F.when(F.col("cwd").isNull() | (F.col("cwd") == ""), None).otherwise(t.repo_of(F.col("cwd"))).alias("repo"), F.nullif("harness", F.lit("")).alias("harness"))
    sets = named.groupingSets([[F.col("repo")], [F.col("harness")]], "repo", "harness").agg(F.count("*").alias("n"), F.grouping("repo").alias("of_harness"))
    found = sets.select(F.when(F.col("of_harness") == 1, "harness").otherwise("repo").alias("facet"), F.when(F.col("of_harness") == 1, F.col("harness")).otherwise(F.col("repo")).alias("value"), "n").where("value is not null")
    always = rows.sparkSession.createDataFrame([("harness", h, 0) for h in HARNESSES], "facet string, value string, n long")
    return found.unionByName(always).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def filtered(rows: DataFrame, now: Column, repo: str = "all", harness: str = "all", preset: str = "all") -> DataFrame:
    """Rows that pass the filters; `all`, an empty repository, and a harness that isn't known, mean no limit."""
    if repo not in ("", "all"):
        rows = rows.where((F.coalesce("cwd", F.lit("")) != "") & (t.repo_of(F.col("cwd")) == repo))
    if harness in HARNESSES:
        rows = rows.where(F.col("harness") == harness)
    begin = since(preset, now)
    return rows if begin is None else rows.where(F.col("ts") >= begin)


def session_history(injections: DataFrame, now: Column, repo: str = "all", harness: str = "all", preset: str = "all", most: int = SESSIONS) -> DataFrame:
    """(place, session_id, last_ts, deliveries, tokens, repo, harness) of the newest sessions among the filtered newest rows."""
    rows = filtered(newest_rows(injections), now, repo, harness, preset)
    sums = rows.groupBy("session_id").agg(
        F.max("ts").alias("last_ts"), F.count("*").alias("deliveries"), F.sum("tokens").alias("tokens"),
        F.max_by(t.repo_of(F.col("cwd")), F.struct("ts", "cwd")).alias("repo"), F.max_by("harness", F.struct("ts", "harness")).alias("harness"),
    )
    place = F.row_number().over(Window.orderBy(F.desc("last_ts"), "session_id"))  # over the sessions of 500 rows at most
    return sums.withColumn("place", place).where(F.col("place") <= most).select("place", "session_id", "last_ts", "deliveries", "tokens", "repo", "harness")


def verdict_counts(injections: DataFrame, judged: DataFrame, now: Column, repo: str = "all", harness: str = "all", days: int = 7) -> DataFrame:
    """(bucket, cards): verdicts on the cards that the filters leave of a window; the verdicts themselves know no filter.

    judged: card_id, bucket over the whole log. So a card's verdict never changes with a filter, only whether it counts.
    """
    window = injections.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    cards = filtered(window, now, repo, harness).select("card_id").distinct()
    return cards.join(judged, "card_id", "left").groupBy(F.coalesce("bucket", F.lit("uncertain")).alias("bucket")).agg(F.count("*").alias("cards"))
