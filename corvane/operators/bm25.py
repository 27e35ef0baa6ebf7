"""BM25 over card fields: of a card's words only those that a query asks for leave its row, and they stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

#: Weights of the fields, depth of the ranking, and the usual constants.
WEIGHTS = {"title": 4, "summary": 2, "body": 1, "extra": 3}
DEPTH, K1, B = 50, 1.2, 0.75
#: Scores of a query's term and a card that a task sums up, on average; more of them make further tasks.
SUMMED = 1_000_000
#: No word is empty, so the empty term counts cards.
_CARD = ""


def _words(cards: DataFrame) -> DataFrame:
    """(id, dl, words, until): the words of all fields one after another, their number, and where each field ends."""
    extra = F.concat_ws(" ", F.concat_ws(" ", "aliases"), F.concat_ws(" ", "trig_kw"))
    fields = {"title": F.col("title"), "summary": F.col("summary"), "body": F.col("body"), "extra": extra}
    rows = cards.select("id", *(t.all_words(F.coalesce(v, F.lit(""))).alias(f"_{k}") for k, v in fields.items()))
    ends = [sum((F.size(f"_{k}") for k in list(fields)[: n + 1]), F.lit(0)) for n in range(len(fields))]
    return rows.select("id", ends[-1].alias("dl"), F.concat(*(f"_{k}" for k in fields)).alias("words"), F.array(*ends).alias("until"))


def postings(cards: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(id, dl, term, tf) of the `wanted` (term) terms: weighted frequency over the fields of a card, and its number of words.

    Only those words leave the row of their card, and they are dealt by card, to `parts` tasks: a term that most cards have
    is spread over all of them, and their number isn't lowered where words take little room but give many scores.
    """
    rows = _words(cards).select("id", "dl", "until", F.posexplode("words").alias("pos", "term"))
    weight = F.lit(list(WEIGHTS.values())[-1])
    for k, w in reversed(list(enumerate(WEIGHTS.values()))[:-1]):
        weight = F.when(F.col("pos") < F.get("until", k), w).otherwise(weight)
    found = rows.join(wanted, "term", "left_semi").select("id", "dl", "term", weight.alias("w")).repartition(parts, "id")
    return found.groupBy("id", "dl", "term").agg(F.sum("w").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(t.terms(F.col("query"), t.QUERY_TERMS)).alias("term"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows kept by the executors and counted, so that the planner knows their size and broadcasts them only if small."""
    kept = rows.persist()
    kept.count()
    return kept


def term_stats(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df, words) of the `wanted` terms that occur, and of the empty one: cards that have it, and their words."""
    card = wanted.sparkSession.range(1).select(F.lit(_CARD).alias("term"))
    terms = _sized(wanted.select("term").distinct().unionByName(card))
    once = F.array_append(F.array_distinct("words"), F.lit(_CARD))
    rows = _words(cards).select("dl", F.explode(once).alias("term")).join(terms, "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"))


def scores(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25) of every card that has a term of the query.

    Cards are read twice: for the statistics of terms, and for the scores. What is shuffled are the words that a query asks
    for, once; scores of a card are summed up where its words are, and `top` keeps the best of each task before it merges
    them. A card without words, or a query without terms, has no row.
    """
    wanted = query_terms(queries)
    stats = _sized(term_stats(cards, wanted))
    whole = stats.where(F.col("term") == _CARD).select(F.col("df").cast("double").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"), F.lit(1).alias("k"))
    known = stats.where(F.col("term") != _CARD).withColumn("k", F.lit(1)).join(F.broadcast(whole), "k")  # `whole` is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = _sized(wanted.join(known.select("term", idf.alias("idf"), "avgdl"), "term"))
    summed = wanted.join(stats, "term").agg(F.sum("df")).first()[0] or 0
    parts = max(int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-summed // SUMMED))
    hits = postings(cards, stats.where(F.col("term") != _CARD).select("term"), parts)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return hits.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))


def top(scored: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The best `depth` cards of each query with their rank; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 6)), "id")
    return scored.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= depth)
