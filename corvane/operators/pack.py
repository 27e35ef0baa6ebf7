"""Packing of candidates under a token budget, after a diversity re-order; one small group for each query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as t

LAMBDA, MOST_CARDS, BODY_TOKENS, FILL, SUMMARY_PLACES = 0.7, 8, 400, 90, 4
LEVELS = {"hook": 1, "summary": 2, "body": 3}
OUT = "query_id long, id string, place int, granularity string, tokens int"


def diverse_order(score: list[float], pinned: list[bool], vecs: list) -> list[int]:
    """Pins first; then, one by one, the candidate with the best relevance less likeness to those taken."""
    top = max(score, default=0.0)
    if len(score) < 3 or top <= 0:
        return list(range(len(score)))
    taken = [i for i, p in enumerate(pinned) if p]
    pool = [i for i, p in enumerate(pinned) if not p]

    def like(i: int, j: int) -> float:
        a, b = vecs[i], vecs[j]
        return float(np.dot(np.asarray(a, float), np.asarray(b, float))) if a is not None and b is not None and len(a) == len(b) else 0.0

    while pool:
        value = [LAMBDA * score[i] / top - (1 - LAMBDA) * max([0.0, *(like(i, j) for j in taken)]) for i in pool]
        taken.append(pool.pop(int(np.argmax(value))))
    return taken


def pack(candidates: DataFrame, budget: int, already: DataFrame | None = None, hooks: int = 0) -> DataFrame:
    """(query_id, id, place, granularity, tokens) of what is sent for each query.

    candidates: query_id, id, place, score, pinned, vec, and the token counts tok_body, tok_hook, text_summary and
    text_body of the rendered forms. `already` (query_id, id, level) is what the session has; only a higher level goes out.
    A query has at most twelve candidates, so its group is small.
    """
    rows = candidates
    rows = rows.join(already, ["query_id", "id"], "left") if already is not None else rows.withColumn("level", F.lit(0))
    usable = budget * FILL // 100

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        order = diverse_order(group["score"].tolist(), group["pinned"].tolist(), group["vec"].tolist())
        spent, pointers, out = 0, 0, []
        for i, at in enumerate(order):
            if len(out) >= MOST_CARDS:
                break
            c = group.loc[at]
            whole = (i == 0 or c["pinned"]) and c["tok_body"] <= BODY_TOKENS
            ceiling = "body" if whole else "summary" if i < SUMMARY_PLACES else "hook"
            have = 0 if pd.isna(c["level"]) else int(c["level"])
            for form in ("body", "summary", "hook"):
                if LEVELS[form] > LEVELS[ceiling]:
                    continue
                if LEVELS[form] <= have:
                    break
                tokens = int(c[f"tok_{form}" if form == "hook" else f"text_{form}"])
                if tokens == 0 or tokens > usable - spent:
                    continue
                if form == "hook":
                    if pointers >= hooks:
                        break
                    pointers += 1
                spent += tokens
                out.append((c["query_id"], c["id"], len(out) + 1, form, tokens))
                break
        return pd.DataFrame(out, columns=["query_id", "id", "place", "granularity", "tokens"])

    return rows.groupBy("query_id").applyInPandas(run, OUT)


def rendered(cards: DataFrame) -> DataFrame:
    """`cards` with the token counts that packing needs."""
    text = lambda *parts: F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("title"), *parts)
    summary = text(F.lit(": "), F.col("summary"))
    body = text(F.lit(" — "), F.col("body"))
    hook = F.concat(F.lit("▸ "), F.col("short_id"), F.lit(" "), F.col("title"), F.lit(": "), t.first_line(F.col("summary")))
    return cards.withColumns({"tok_body": t.token_estimate(F.col("body")), "text_summary": t.token_estimate(summary), "text_body": F.when(F.col("body") == "", 0).otherwise(t.token_estimate(body)), "tok_hook": t.token_estimate(hook)})


def short_ids(cards: DataFrame) -> DataFrame:
    """`cards` with short_id: four hex digits of the id's hash, and a number where an earlier card has them."""
    from pyspark.sql import Window

    head = t.short_hash(F.col("id"), 4)
    nth = F.row_number().over(Window.partitionBy("_head").orderBy("index_seq", "id")) - 1
    return cards.withColumn("_head", head).withColumn("short_id", F.concat("_head", F.when(nth > 0, nth.cast("string")).otherwise(""))).drop("_head")
