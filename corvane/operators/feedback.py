"""Feedback: decayed counters, utility, verdicts on cards, and penalties settled once per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_HOURS = 336.0
EXPANDED, REFERENCED, DOWNVOTED = 3, 5, 5
MIN_OBSERVED, EXPENSIVE_TOKENS, NOISY_FLOOR = 3.0, 1500, 1.0
PENALTY, CREDIT = 0.1, 0.5
KINDS = ("injected", "expanded", "referenced", "downvoted")


def decay(ts: Column, now: Column) -> Column:
    """Half for each fortnight that has passed; 1 for none, or a time to come."""
    hours = (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9
    return F.when(hours > 0, F.pow(F.lit(0.5), hours / HALF_LIFE_HOURS)).otherwise(1.0)


def decayed_stats(feedback: DataFrame, now: Column) -> DataFrame:
    """(card_id, injected, expanded, referenced, downvoted) as of `now`.

    Decaying and adding step by step equals one sum of decayed deltas, which any order of rows and partial sums give.
    """
    part = F.col("delta") * decay(F.col("ts"), now)
    sums = [F.sum(F.when(F.col("kind") == k, part).otherwise(0.0)).alias(k) for k in KINDS]
    return feedback.where(F.col("kind").isin(*KINDS)).groupBy("card_id").agg(*sums)


def utility(stats: DataFrame) -> DataFrame:
    """(card_id, utility): 2 (good + 1) / (good + bad + 2), between a half and one and a half."""
    good, bad = F.col("expanded") + F.col("referenced"), F.col("downvoted")
    return stats.select("card_id", F.greatest(F.lit(0.5), F.least(F.lit(1.5), 2 * (good + 1) / (good + bad + 2))).alias("utility"))


def window_usage(injections: DataFrame) -> DataFrame:
    """(card_id, injections, tokens) over the log."""
    return injections.groupBy("card_id").agg(F.count("*").alias("injections"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def effectiveness(stats: DataFrame, usage: DataFrame) -> DataFrame:
    """(card_id, bucket, positive, negative, pull_rate) for every card with feedback or deliveries."""
    rows = stats.join(usage, "card_id", "full_outer").fillna(0)
    rows = rows.withColumn("positive", EXPANDED * F.col("expanded") + REFERENCED * F.col("referenced")).withColumn("negative", DOWNVOTED * F.col("downvoted"))
    seen = F.greatest("injected", F.col("injections").cast("double"))
    pull = F.when(seen > 0, F.least(F.lit(1.0), (F.col("expanded") + F.col("referenced")) / seen)).otherwise(0.0)
    bucket = (
        F.when((F.col("negative") > F.col("positive")) & (F.col("negative") > NOISY_FLOOR), "noisy").when(F.col("positive") > 0, "helpful")
        .when(seen < MIN_OBSERVED, "uncertain").when(F.col("tokens") >= EXPENSIVE_TOKENS, "expensive").otherwise("uncertain")
    )
    return rows.select("card_id", bucket.alias("bucket"), "positive", "negative", pull.alias("pull_rate"))


def first_claims(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each session: claims and penalties are settled once."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where("nth = 1").drop("nth")


def abandoned_pointers(injections: DataFrame) -> DataFrame:
    """(session_id, card_id) of pointers that nobody followed: given as `hook`, and in no other form in the same session."""
    hooks = injections.where("granularity = 'hook'").select("session_id", "card_id").distinct()
    content = injections.where("granularity != 'hook'").select("session_id", "card_id").distinct()
    return hooks.join(content, ["session_id", "card_id"], "left_anti")


def penalties(abandoned: DataFrame, ended: Column) -> DataFrame:
    """Feedback rows for abandoned pointers."""
    return abandoned.select("card_id", F.lit("downvoted").alias("kind"), F.lit(PENALTY).alias("delta"), ended.alias("ts"))


def folded(stats: DataFrame, as_of: Column, new: DataFrame, now: Column) -> DataFrame:
    """The counters of `stats`, as of a time, decayed to `now` and raised by new feedback.

    So a run reads the last snapshot and what came since, not the whole log. Feedback of another kind counts nothing.
    """
    old = stats.select("card_id", *(F.coalesce(F.col(k) * decay(as_of, now), F.lit(0.0)).alias(k) for k in KINDS))
    rows = old.unionByName(decayed_stats(new, now))
    return rows.groupBy("card_id").agg(*(F.sum(k).alias(k) for k in KINDS))


def expansions(found: DataFrame, ts: Column) -> DataFrame:
    """Feedback rows for cards that were asked for in full."""
    return found.select(F.col("id").alias("card_id"), F.lit("expanded").alias("kind"), F.lit(1.0).alias("delta"), ts.alias("ts"))
