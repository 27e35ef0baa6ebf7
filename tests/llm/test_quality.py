import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.op6_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_repeats(spark):
    w = [f"w{i}" for i in range(30)]
    texts = [" ".join(w[:10] + w[:10]), " ".join(["a"] * 40), " ".join(w + ["x"] + w[5:20] + ["y"] + w[3:11]), "a\n\n a\na\n a", "\x0b".join(w), "a b c d", None, ""]
    rows = quality.signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def test_estimation_finds_kinds_of_junk():
    """Two kinds of junk, each seen by two rules and passed by the other two; a fifth rule abstains and errs more often."""
    rng, seen = random.Random(1), Counter()
    for _ in range(20_000):
        kind = rng.choices("gab", [8, 1, 1])[0]
        votes = [-1 if rng.random() < (0.95 if kind == k else 0.01) else 1 for k in "aabb"]
        fifth = -1 if rng.random() < (0.03 if kind == "g" else 0.5) else 1
        seen[(*votes, fifth if rng.random() < 0.7 else 0)] += 1
    model = quality.fit(sorted(seen.items()), ["a1", "a2", "b1", "b2", "c"])
    assert 0.7 < model.shares["good"] < 0.9 and all(0.8 < model.accuracy(k) < 0.98 for k in model.names)
    assert model.good((1, 1, 1, 1, 1)) > 0.99 and model.good((-1, -1, 1, 1, 0)) < 0.1 and model.good((1, 1, -1, -1, 1)) < 0.1


def test_agrees_with_labels(spark):
    """Labels play no part in the estimation."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.op6_quality_rules(spark, d).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["label"] == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_odd_tables(odd_docs, no_docs):
    out = quality.judge(odd_docs)
    assert out.count() == odd_docs.count() and not out.where("doc_id in (1, 2, 3)").where("kept").count()
    assert quality.judge(no_docs).count() == 0


def test_columns_of_any_name(odd_docs):
    plain = {r["text"]: (r["kept"], r["quality"]) for r in quality.judge(odd_docs.withColumn("own", F.col("text")).drop("text").withColumnRenamed("own", "text").withColumn("copy", F.col("text"))).withColumnRenamed("copy", "text").collect()}
    for names in (("_hashes", "_text", "_lines", "_windows"), ("_sorted", "_starts", "_votes", "_row"), ("row", "n_words", "kept", "none")):
        rows = odd_docs.withColumnsRenamed(dict(zip(("component", "score", "code", "size"), names, strict=True))).withColumn("copy", F.col("text"))
        out = quality.judge(rows)
        assert {c for c in rows.columns if c not in ("text", "n_words", "kept")} <= set(out.columns)
        assert {r["copy"]: (r["kept"], r["quality"]) for r in out.collect()} == plain
