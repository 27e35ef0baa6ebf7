import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import toxicity

WORDS = ["the", "of", "and", "river", "stone", "walks", "green", "house", "light", "again"]


def text(rng, toxic):
    said = [[rng.choice(WORDS) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(2, 12))]
    if toxic:
        for _ in range(2):
            rng.choice(said).insert(0, rng.choice(["vilest", "rotten"]))
    return ". ".join(" ".join(s) for s in said) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    rows = [(text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    return toxicity.fit([t for t, _ in rows], [y for _, y in rows])


def test_learns_from_document_labels(model):
    rng, scorer = random.Random(9), model.scorer()
    assert all(scorer.score(text(rng, True)) >= 0.7 for _ in range(200))
    assert all(scorer.score(text(rng, False)) < 0.3 for _ in range(200))


def test_noisy_or_and_places(model):
    scorer = model.scorer()
    parts = ["the river of stone", "you vilest rotten house", "green light again"]
    whole = ". ".join(parts) + "."
    miss = 1.0
    for p in parts:
        miss *= 1 - scorer.score(p)
    assert scorer.score(whole) == pytest.approx(1 - miss, abs=1e-9)
    found = scorer.offending(whole.title(), 0.5)
    assert [whole[x["start"] : x["end"]].strip() for x in found] == [parts[1]]
    assert scorer.score(None) == 0.0 and scorer.score("") == 0.0 and scorer.score(" . !") == 0.0


def test_length_is_no_evidence(model):
    rng, scorer = random.Random(4), model.scorer()
    clean = " ".join(text(rng, False) for _ in range(3000))
    assert clean.count(".") > 20_000 and scorer.score(clean) < 0.01
    assert scorer.score(clean + " you vilest rotten house.") >= 0.7


def test_long_clean_texts_of_the_tables_stay():
    d = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id").dropna(subset=["text"])
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]
    seen, clean = rows[[not h for h in held]], rows[held].query("toxic == 0")
    scorer = toxicity.fit(list(seen["text"]), list(seen["toxic"].astype(int))).scorer()
    # texts that pass alone must pass together
    joined = ". ".join(t for t in clean["text"] if scorer.score(t) < toxicity.THRESHOLD / 2)
    assert len(joined) > 1_000_000 and scorer.score(joined) < toxicity.THRESHOLD


def test_sample_has_long_texts(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i} " * (9000 if i == ids[3] else 2)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(texts))
    toxicity.train(docs, labels)
    assert len(seen[0]) == len(ids) and max(map(len, seen[0])) > 60_000
    toxicity.train(docs, labels, sample_chars=50)
    assert 2 <= len(seen[1]) <= 12


def test_one_class_only():
    assert toxicity.fit(["a b", "c d"], [0, 0]).scorer().score("a b") < 1e-6 and toxicity.fit([], []).weights == {}


def test_training_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"common words {'awful' if i % 2 else 'fine'} number {'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}") for i in range(300)], "doc_id long, text string")
    held = docs.where("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    wrong = labels.join(held, "doc_id").withColumn("toxic", 1 - F.col("toxic"))
    model = toxicity.train(docs, labels.join(held, "doc_id", "left_anti").unionByName(wrong))
    assert model.scorer().score("awful words") > model.scorer().score("fine words")


def test_held_out_accuracy(spark):
    from corvane.llm.queries import op3_toxicity

    d = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(right) >= 0.97 * len(right) and sum(caught) >= 0.85 * len(caught) and sum(clean) <= 0.01 * len(clean)


def test_odd_tables(spark, model, odd_docs, no_docs):
    out = toxicity.score(odd_docs, model)
    assert out.count() == odd_docs.count() and out.where("text is null").first()["score"] == 0.0
    assert toxicity.locate(odd_docs, model).where("size(offending) > 0").count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(odd_docs, labels).weights == {} and toxicity.score(no_docs, model).count() == 0


def test_served_as_trained(model):
    """A plain noisy-or over sentences gives the same scores as the operator."""
    import math
    import re

    rng, scorer = random.Random(6), model.scorer()

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = set(re.findall(r"[^\W\d_]+", sentence))
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w] + [w[:k] + "*" for k in (4, 5) if len(w) > k])
            p, least = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-model.bias))
            if words and p > least:
                clean *= (1 - p) / (1 - least)
        return 1 - clean

    for i in range(100):
        said = text(rng, i % 3 == 0).upper() + "\n? 12 _"
        assert scorer.score(said) == pytest.approx(plain(said), abs=1e-9)


def test_small_scores_do_not_add_up(model):
    """Clean texts joined score no more than 0.01, though no sentence is cut off at a bound of its own."""
    rng, scorer = random.Random(8), model.scorer()
    found = [scorer.evidence(s) for s in text(rng, False).split(".")]
    assert min(found) >= 0 and scorer.score(". ".join(text(rng, False) for _ in range(2000))) < 0.01
