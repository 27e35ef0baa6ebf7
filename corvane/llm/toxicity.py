"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is toxic if at least one of its sentences is: P = 1 - prod(1 - p_s), with a logistic p_s over the words of a
sentence and their first four and five letters, beyond what a sentence without known words would have (the background;
what lies under it counts as zero). Only documents are labelled; training maximises their likelihood under this very
model, and the sentence scores then locate what offends. Clean texts joined are clean too, so in training each clean
text also is one of JOINED of such a bag: thus small scores don't add up with the length of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import keep

THRESHOLD = 0.7
#: Weight of the bags of joined clean texts, and the share of toxic labels that need no evidence.
JOINED, NOISE = 20, 0.05
#: Bounds of the training sample of each class: labelled rows, and characters of all its texts, the last one whole.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 8_000_000
_WORDS = re.compile(r"[^\W\d_]+").findall
_SENTENCE = re.compile(r"[^.!?\n]+")
_CACHE = 300_000


def features(word: str) -> tuple[str, ...]:
    """A word, and its first four and five letters if it goes on."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k))


@dataclass
class ToxicityModel:
    """A logistic sentence model: its bias and the weights of features; others weigh nothing."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> _Scorer:
        return _Scorer(self.bias, self.weights)


class _Scorer(dict):
    """Weights of whole words, made up when first met and forgotten when there are too many."""

    def __init__(self, bias: float, weights: dict[str, float]):
        super().__init__()
        self.bias, self.weights = bias, weights
        self.background = math.log1p(math.exp(bias))

    def __missing__(self, word: str) -> float:
        if len(self) > _CACHE:
            self.clear()
        self[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def evidence(self, sentence: str) -> float:
        """-log(1 - p) of one sentence in lower case, beyond that of a sentence without known words; 0 if there's none beyond."""
        words = set(_WORDS(sentence))
        if not words:
            return 0.0
        z = self.bias + sum(map(self.__getitem__, words))
        return max((math.log1p(math.exp(z)) if z < 30 else z) - self.background, 0.0)

    def score(self, text: str | None) -> float:
        return 0.0 - math.expm1(-sum(map(self.evidence, _SENTENCE.findall((text or "").lower()))))

    def offending(self, text: str | None, least: float) -> list[dict]:
        """Sentences with a score of `least` or more, as code points of the text (end exclusive)."""
        out = []
        for m in _SENTENCE.finditer(text or ""):
            p = -math.expm1(-self.evidence(m[0].lower()))
            if p >= least:
                out.append({"start": m.start(), "end": m.end(), "score": p})
        return out


def _bags(text: str) -> Iterator[Counter]:
    """Features of each sentence that has words."""
    for sentence in _SENTENCE.findall(text.lower()):
        if words := set(_WORDS(sentence)):
            yield Counter(f for w in words for f in features(w))


def fit(texts: list[str], toxic: list[int], epochs: int = 200, rate: float = 0.15, decay: float = 0.03, least: int = 5) -> ToxicityModel:
    """Trains on a bounded sample in the driver; equal texts count once. With one class only, nothing is held toxic.

    The chance of a clean label is (1 - NOISE) * prod(1 - p_s) for a single text, and prod(1 - p_s) for clean texts joined.
    """
    rows = sorted(dict(zip(texts, toxic, strict=True)).items())
    if len({y for _, y in rows}) < 2:
        return ToxicityModel()
    y = np.array([y for _, y in rows])
    n, pos = Counter(), Counter()
    for text, label in rows:
        seen = {f for s in _bags(text) for f in s}
        n.update(seen)
        if label:
            pos.update(seen)
    share = y.mean()
    # a feature is kept if some documents have it and are toxic markedly more or less often than others
    names = [f for f, k in n.items() if k >= least and abs(pos[f] - k * share) >= 3 * math.sqrt(k * share * (1 - share))]
    number = {f: i for i, f in enumerate(sorted(names))}
    doc, sent, feat, times = [], [], [], []
    for d, (text, _) in enumerate(rows):
        for s in _bags(text):
            for f, k in s.items():
                if f in number:
                    sent.append(len(doc))
                    feat.append(number[f])
                    times.append(k)
            doc.append(d)
    doc, sent, feat, times = (np.array(x, np.int64) for x in (doc, sent, feat, times))
    w, b = np.zeros(len(number)), -4.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weigh = np.where(y == 1, 0.5 / share, (0.5 + JOINED) / (1 - share)) / len(y)
    for t in range(1, epochs + 1):
        z = np.clip(b + np.bincount(sent, w[feat] * times, len(doc)), -30, 30)
        evidence = np.log1p(np.exp(z)) - np.log1p(np.exp(b))
        beyond = evidence >= 0
        miss = (1 - NOISE) * np.exp(-np.bincount(doc, np.where(beyond, evidence, 0.0), len(y)))
        by_doc = (weigh * np.where(y == 1, -miss / (1 - miss), 1.0))[doc] * beyond
        pull = by_doc / (1 + np.exp(-z))
        grad = np.append(np.bincount(feat, pull[sent] * times, len(w)) + decay / len(y) * w, pull.sum() - by_doc.sum() / (1 + np.exp(-b)))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel(float(b), {f: round(float(w[i]), 4) for f, i in number.items() if abs(w[i]) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fits a model to labelled documents of which crc32(doc_id as text) mod 3 is not 1.

    The sample holds, of each class, the `sample_rows` rows whose hashed doc_id is lowest, in that order until they hold
    `sample_chars` characters together; so its size has a bound, and texts of any length are in it. Null labels, ids and
    texts are left out; a document labelled more than once is toxic if any of its labels says so.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 3 != 1").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    chosen = keep(parts[0].unionByName(parts[1]))  # bounded by 2 * sample_rows narrow rows, so it may be broadcast
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sizes = texts.groupBy("toxic", "doc_id").agg(F.sum(F.length("text")).alias("chars"))
    before = F.sum("chars").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    within = keep(sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_chars).select("doc_id"))
    rows = texts.join(F.broadcast(within), "doc_id").select("text", "toxic").distinct().collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """`docs` with `column`, the score of each whole text; null and empty texts score 0, as they have no sentence.

    Texts of any length are read whole, rows are scored one by one, repeated ones alike, and an empty table stays empty.
    A column of that name is replaced, the others stay.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, scores("text"))


def locate(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """`docs` with `offending`: places and scores of the sentences that score `least` or more; none for a null text.

    A column of that name is replaced; rows and other columns stay.
    """

    @F.pandas_udf("array<struct<start:int,end:int,score:double>>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.offending(t, least) for t in texts])

    return docs.withColumn("offending", places("text"))
