"""Quality by weak supervision, with DataFrame functions only.

Rules vote for or against a document or abstain. Expectation-maximisation over how often each combination of votes
occurs estimates, without labels, how the votes of each rule depend on the hidden quality; a document is kept by the
posterior probability that it is good, in place of having to pass every rule.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, free_name, keep, table, text_or_empty

WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"


def signals(docs: DataFrame) -> DataFrame:
    """`docs` with the counts that the rules use (null text: no words); they take the place of columns of their names."""
    rows = docs.select(F.struct("*").alias("_row"), text_or_empty().alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumns({"_hashes": F.transform(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)), "_lines": lines})
    windows = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, i, k: F.coalesce(F.get("_sorted", i + k)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform("_sorted", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"])), lambda p: p.isNotNull())
    rows = rows.withColumn("_starts", F.sort_array(twice))
    # each repeated window covers the words up to the next one's start, eight at most
    cover = F.transform("_starts", lambda p, i: F.least(F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    count = lambda c: c.cast("long")
    rows = rows.withColumns(
        {
            "n_words": count(F.size("_hashes")),
            "word_chars": count(F.length(F.regexp_replace("_text", _SPACE, ""))),
            "n_symbols": count(F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))),
            "n_lines": count(F.size("_lines")),
            "n_dup_lines": count(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_distinct_words": count(F.size(F.array_distinct("_hashes"))),
            "n_letters": count(F.length(F.regexp_replace("_text", r"\P{L}+", ""))),
            "n_upper": count(F.length(F.regexp_replace("_text", r"\P{Lu}+", ""))),
            "n_stops": count(F.length("_text") - F.length(F.translate("_text", ".!?", ""))),
        }
    )
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in SIGNALS), *SIGNALS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 to abstain."""
    col = F.col

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": rule(col("n_words") >= 50, col("n_words") < 20),
        "symbols": rule(100 * col("n_symbols") <= col("n_words"), 100 * col("n_symbols") > 20 * col("n_words")),
        "lines": rule(2 * col("n_dup_lines") <= col("n_lines"), 2 * col("n_dup_lines") > col("n_lines")),
        "repeats": rule(100 * col("n_repeat_words") <= 30 * col("n_words"), 100 * col("n_repeat_words") > 30 * col("n_words")),
        "case": rule(100 * col("n_upper") <= 10 * col("n_letters"), 100 * col("n_upper") > 30 * col("n_letters")),
        "letters": rule(100 * col("n_letters") >= 91 * col("word_chars"), 100 * col("n_letters") < 80 * col("word_chars")),
        "variety": rule(col("n_distinct_words") * col("n_distinct_words") >= 4 * col("n_words"), 100 * col("n_distinct_words") < 20 * col("n_words")),
        "sentences": rule(60 * col("n_stops") >= col("n_words"), 300 * col("n_stops") < col("n_words")),
    }


@dataclass
class LabelModel:
    """What the estimation found: the share of good documents, each rule's rates of votes on them, and of each bad kind."""

    names: list[str]
    shares: dict[str, float]
    rates: dict[str, list[dict[int, float]]]

    def good(self, votes: tuple[int, ...]) -> float:
        """Posterior probability that a document with these votes is good."""
        return _posterior(self, votes)[GOOD]

    def accuracy(self, name: str) -> float:
        """Probability that a vote of this rule, if it votes, is right."""
        j, right, all_ = self.names.index(name), 0.0, 0.0
        for kind, share in self.shares.items():
            rate = self.rates[kind][j]
            right += share * rate[1 if kind == GOOD else -1]
            all_ += share * (rate[1] + rate[-1])
        return right / all_


GOOD = "good"
#: Where the estimation starts: rates of a vote on documents that a rule has nothing against, and on the kind it stands for.
_TYPICAL, _OWN = {-1: 0.02, 0: 0.08, 1: 0.9}, {-1: 0.9, 0: 0.08, 1: 0.02}
#: Share of the start in each estimate, so that rates behave alike at every size; and the least rate of bad votes of a rule
#: on the kind that it stands for.
_SHRINK, _CHANCE = 0.2, 0.5


def _posterior(model: LabelModel, votes: tuple[int, ...]) -> dict[str, float]:
    log = {k: math.log(share) + sum(math.log(model.rates[k][j][v]) for j, v in enumerate(votes)) for k, share in model.shares.items()}
    most = max(log.values())
    weight = {k: math.exp(x - most) for k, x in log.items()}
    total = sum(weight.values())
    return {k: w / total for k, w in weight.items()}


def _rates(hits: dict[int, float], start: dict[int, float], own: bool) -> dict[int, float]:
    """Shares of the votes, shrunk to the start; a rule that stands for the kind votes bad on half of it at least."""
    total = sum(hits.values())
    rates = {v: _SHRINK * start[v] + (1 - _SHRINK) * (h / total if total else start[v]) for v, h in hits.items()}
    if own and rates[-1] < _CHANCE:
        rates = {v: _CHANCE if v == -1 else r * (1 - _CHANCE) / (1 - rates[-1]) for v, r in rates.items()}
    return rates


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over the combinations of votes and their counts; there are at most 3 ** len(names).

    A document is good or bad in one of several kinds, one for each rule: junk comes in kinds that other rules pass, so
    one class of bad documents would follow whichever rules agree most and turn the others round. All rates are
    estimated, those of a rule on its own kind too, where it only has to beat chance. So a bad vote counts for as much as
    the other rules' votes on such documents bear it out, and can be outvoted.
    """
    start = {k: [_OWN if n == k else _TYPICAL for n in names] for k in (GOOD, *names)}
    model = LabelModel(names, {GOOD: 0.8} | {n: 0.2 / len(names) for n in names}, {k: [dict(r) for r in start[k]] for k in start})
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        share = {k: 1.0 for k in model.shares}
        hits = {k: [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in names] for k in start}
        for votes, n in patterns:
            for k, p in _posterior(model, votes).items():
                share[k] += n * p
                for j, v in enumerate(votes):
                    hits[k][j][v] += n * p
        rates = {k: [_rates(by, r, name == k) for name, by, r in zip(names, hits[k], start[k], strict=True)] for k in hits}
        model = LabelModel(names, {k: s / sum(share.values()) for k, s in share.items()}, rates)
    return model


def judge(docs: DataFrame) -> DataFrame:
    """`docs` with the signals, base_failed, the posterior `quality` and `kept`.

    A document is kept if it passes the base and its posterior is at least 0.5. The votes of all rows are counted by
    combination, which leaves a bounded table for the estimation. Null and empty texts fail the base; repeated rows each
    count and are judged alike; an empty table gives no rows. The text, and columns named as the new ones are, go.
    """
    rules = votes()
    new = {*SIGNALS, "text", "base_failed", "quality", "kept"}
    number = sum(((v + 1) * 3**j for j, v in enumerate(rules.values())), F.lit(0)).cast("int")
    rest = [c for c in docs.columns if c not in new]
    one_row = F.struct(*(F.col(c) for c in rest), F.lit(0).alias(free_name(docs, "none")))  # what the caller has can't clash within a struct
    rows = keep(signals(docs.select(one_row.alias("row"), "text")).select("row", *SIGNALS).withColumn("_votes", number))
    combination = lambda x: tuple(x // 3**j % 3 - 1 for j in range(len(rules)))
    counted = sorted((r["_votes"], r["count"]) for r in rows.groupBy("_votes").count().collect())
    model = fit([(combination(x), n) for x, n in counted], list(rules))
    good = {x: model.good(combination(x)) for x, _ in counted}
    by_votes = F.from_json(F.lit(json.dumps([good.get(x, 0.5) for x in range(3 ** len(rules))])), "array<double>")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("quality", F.get(by_votes, F.col("_votes")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in rest), *SIGNALS, "base_failed", "quality", "kept")


SIGNALS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper", "n_stops"]


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null and empty texts have no words and fail the base."""
    rows = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
