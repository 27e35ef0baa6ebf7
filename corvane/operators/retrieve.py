"""Hybrid retrieval for a batch of queries: BM25 and cosine ranks, fused, weighed by utility, floored and capped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import vectors
from corvane.operators import bm25, scope

RRF, COSINE_DEPTH, COSINE_FLOOR, CANDIDATES, PINS, LOST_PIN, TRIGGER = 60.0, 50, 0.60, 12, 2, 0.01, 4
#: Query and card vectors that meet in a task at most, on average; more of them make further blocks and shards. Queries of
#: one matrix product.
QUERY_BLOCK, CARD_SHARD, _STEP = 4096, 10_000, 256


def cosine_top(cards: DataFrame, queries: DataFrame, depth: int = COSINE_DEPTH, within: str | None = None, digits: int = 9) -> DataFrame:
    """(query_id, id, cosine, cosine_rank): the nearest `depth` cards of each query, among those of its `within` if given.

    Cosines that are equal in `digits` digits go by id.

    Queries are dealt to blocks and cards to shards, as columns. Each shard meets each block in one task, in matrix
    products, and keeps its own best for each query; their merge decides. So no number of queries is too large, and the
    shuffle holds `depth` rows for a shard and query, not all pairs.
    """
    same = [within] if within else []
    asked, had = queries.where("vec is not null").select("query_id", "vec", *same), cards.where("vec is not null").select("id", "vec", *same)
    id_type = queries.schema["query_id"].dataType.simpleString()
    blocks, shards = (max(1, -(-df.count() // most)) for df, most in ((asked, QUERY_BLOCK), (had, CARD_SHARD)))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def best(card_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": query_rows["query_id"].head(0), "id": np.empty(0, object), "cosine": np.empty(0)})]
        card_rows = card_rows.sort_values("id")
        for size in set(query_rows["vec"].map(len)) & set(card_rows["vec"].map(len)):
            c, q = card_rows[card_rows["vec"].map(len) == size], query_rows[query_rows["vec"].map(len) == size]
            card_ids, matrix = c["id"].to_numpy(), np.stack(c["vec"].to_numpy()).astype(np.float64).T
            for at in range(0, len(q), _STEP):
                part = q.iloc[at : at + _STEP]
                near = np.stack(part["vec"].to_numpy()).astype(np.float64) @ matrix
                told = near.round(digits)
                # only what reaches a query's depth is put in order, and equal ones by their place, which is that of the id
                least = np.partition(told, -depth, axis=1)[:, -depth, None] if len(c) > depth else -np.inf
                row, col = np.nonzero(told >= least)
                order = np.lexsort((col, -told[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < depth
                row, col = row[kept], col[kept]
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "id": card_ids[col], "cosine": near[row, col]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    left = dealt(had, "id", "shard", shards, "block", blocks).groupBy("shard", "block", *same)
    right = dealt(asked, "query_id", "block", blocks, "shard", shards).groupBy("shard", "block", *same)
    found = left.cogroup(right).applyInPandas(best, f"query_id {id_type}, id string, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", digits)), "id")
    return found.withColumn("cosine_rank", F.row_number().over(order)).where(F.col("cosine_rank") <= depth)


def triggered(keywords: Column, folded: Column) -> Column:
    """A keyword of four bytes or more stands in the folded text between ASCII word boundaries."""
    quoted = lambda k: F.concat(F.lit(r"(?<![a-z0-9])\Q"), t.fold(k), F.lit(r"\E(?![a-z0-9])"))
    return F.exists(keywords, lambda k: (F.octet_length(t.fold(k)) >= TRIGGER) & F.call_function("rlike", folded, quoted(k)))


def matched_terms(query_terms: Column, card_words: Column) -> Column:
    """Query terms that equal a word of the card, or share its first four letters."""
    same = lambda q, w: (q == w) | ((F.length(q) >= 4) & (F.length(w) >= 4) & (F.substring(q, 1, 4) == F.substring(w, 1, 4)))
    return F.size(F.filter(query_terms, lambda q: F.exists(card_words, lambda w: same(q, w))))


def pin_hits(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of cards with a trigger in the query.

    A one-word keyword can only match a word of the query, so words are joined; keywords with other characters are
    joined by their first word and then tested.
    """
    word = lambda c: F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    keys = cards.select("id", F.explode("trig_kw").alias("kw")).withColumn("kw", t.fold(F.col("kw"))).where(F.octet_length("kw") >= TRIGGER).withColumn("head", F.coalesce(F.get(word(F.col("kw")), 0), F.lit("")))
    said = queries.select("query_id", t.fold(F.col("query")).alias("folded")).withColumn("head", F.explode(F.array_distinct(F.concat(word(F.col("folded")), F.array(F.lit(""))))))
    found = said.join(keys, "head").where(F.expr(r"rlike(folded, concat('(?<![a-z0-9])\\Q', kw, '\\E(?![a-z0-9])'))"))
    return found.select("query_id", "id").distinct()


def retrieve(cards: DataFrame, queries: DataFrame, allowed: list[str], utility: DataFrame | None = None) -> DataFrame:
    """(query_id, id, place, score, pinned, bm25_rank, cosine_rank): up to twelve candidates for each query.

    cards: id, title, summary, body, scopes, key, status, aliases, trig_kw, vec; queries: query_id, query, vec (null
    without an embedding). The lexical ranking covers all cards, hidden and out of scope ones too; the cosine ranking
    those in scope, shadowed ones too.
    """
    live = scope.in_scope(cards, allowed)
    shown = scope.unshadowed(live.select("id", "key", "scope_rank")).select("id", "scope_rank")
    lexical = bm25.top(bm25.scores(cards, queries)).select("query_id", "id", "bm25_rank")
    semantic = cosine_top(live, queries).select("query_id", "id", "cosine_rank")
    pins = pin_hits(live, queries).withColumn("pin", F.lit(True))
    arms = lexical.join(semantic, ["query_id", "id"], "full_outer").join(pins, ["query_id", "id"], "full_outer").join(shown, "id")
    words = t.terms(F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "aliases"), F.concat_ws(" ", "trig_kw")))
    rows = arms.join(cards.select("id", words.alias("words"), F.col("vec").alias("card_vec")), "id")
    rows = rows.join(queries.select("query_id", t.terms(F.col("query"), t.QUERY_TERMS).alias("asked"), F.col("vec").alias("query_vec")), "query_id")
    near = F.coalesce(vectors.dot(F.col("card_vec"), F.col("query_vec")), F.lit(0.0))
    enough = F.col("bm25_rank").isNotNull() & (matched_terms(F.col("asked"), F.col("words")) >= F.least(F.lit(2), F.size("asked")))
    pinned = F.coalesce("pin", F.lit(False))
    rows = rows.where(pinned | (near >= COSINE_FLOOR) | enough)
    arm = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    weight = F.lit(1.0)
    if utility is not None:
        rows, weight = rows.join(utility, rows["id"] == utility["card_id"], "left"), F.coalesce("utility", F.lit(1.0))
    score = (arm("bm25_rank") + arm("cosine_rank")) * weight + scope.boost(F.col("scope_rank"))
    return capped(rows.select("query_id", "id", score.alias("score"), pinned.alias("pinned"), "bm25_rank", "cosine_rank"))


def capped(rows: DataFrame, pins: int = PINS, most: int = CANDIDATES) -> DataFrame:
    """Pins first, then by score: the best two pins stay pins, others get a bonus instead; at most twelve rows of a query."""
    by_score = F.desc(F.round("score", 9))
    nth = F.row_number().over(Window.partitionBy("query_id", "pinned").orderBy(by_score, "id"))
    rows = rows.withColumn("lost", F.col("pinned") & (nth > pins))
    rows = rows.withColumns({"pinned": F.col("pinned") & ~F.col("lost"), "score": F.col("score") + F.when(F.col("lost"), LOST_PIN).otherwise(0.0)}).drop("lost")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pinned"), by_score, "id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def search(cards: DataFrame, queries: DataFrame, allowed: list[str], utility: DataFrame | None = None) -> DataFrame:
    """(query_id, place, id, short_id, type, title, summary, score): what an explicit search returns; no gate skips it.

    cards: as for `retrieve`, and short_id. A query without letters finds nothing.
    """
    asked = queries.where(F.trim("query") != "")
    found = retrieve(cards, asked, allowed, utility).select("query_id", "id", "place", "score")
    return found.join(cards.select("id", "short_id", "type", "title", "summary"), "id").select("query_id", "place", "id", "short_id", "type", "title", "summary", "score")
