"""Mixing of sources to target weights: whole copies by the repetition rate, and one Bernoulli copy for its fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, keep, text_or_empty

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Seeds that are tried for each source; the one whose taken words come nearest to the target is used.
SEEDS = 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target of each source from (source, source_size).

    Sources in code point order (null last) weigh `weights`, repeating. `share` times all sizes is shared by weight; no
    target exceeds `most` times its source's size, and what is over goes to the others by weight: water is poured into
    vessels that fill up in the order of size by weight. The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.get(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    s = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left_words = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left_words / left_weight)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight"))
    return s.withColumn("target", target).select("source", "source_size", "target")


def _draw(seed: Column) -> Column:
    """A uniform number in [0, 1) from a seed and a doc_id."""
    text = F.concat_ws(":", seed.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def choices(rows: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(s, source_size, target, whole, part, seed) of each source of the sized `rows`: its rate, and the seed of its draws.

    Both tables of sources are written first: their sizes are known then, and rows are shuffled by source, of which one
    may be hot, only if there are too many sources to broadcast.
    """
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = keep(goal.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")))
    with_goal = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    extra = [F.sum(F.when(_draw(F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"x{k}") for k in range(seeds)]
    miss = lambda k: F.abs(F.col("whole") * F.col("source_size") + F.col(f"x{k}") - F.col("target"))
    tried = with_goal.groupBy("s", "source_size", "target", "whole", "part").agg(*extra)
    best = F.array_min(F.array(*(F.struct(miss(k).alias("miss"), F.lit(k).alias("seed")) for k in range(seeds))))
    return keep(tried.select("s", "source_size", "target", "whole", "part", best["seed"].alias("seed")))


def _copies() -> Column:
    return F.col("whole") + (_draw(F.col("seed")) < F.col("part")).cast("long")


def plan(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """Copies of each row of `docs`: (doc_id, source, size, source_size, target, copies).

    The rate of a source is its target by its size. A row gets floor(rate) copies and one more if its draw is below the
    fraction; the draw hashes the doc_id and the source's seed, so reruns agree. Null texts have size 0, null sources
    are one source, null doc_ids share a draw, repeated rows get equal copies, and a source without words takes none.
    """
    rows = keep(sized(docs))
    found = rows.join(choices(rows, seeds), F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """`docs` with each row as often as `plan` says; columns, whatever their names, and their order stay."""
    chosen = choices(keep(sized(docs)))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source").join(chosen, F.col("source").eqNullSafe(F.col("s")))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")
