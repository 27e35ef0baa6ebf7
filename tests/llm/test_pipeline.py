from collections import Counter

import numpy as np

import corpus_pipeline
from corvane.llm import pii, simhash
from corvane.llm.queries import op5_packing
from tests.llm.test_simhash import brute_word_prints


def plain_least(texts, radius):
    """The ids left once the components within the radius, by one fingerprint after the other, leave their least; all compared with all."""
    prints = {i: brute_word_prints(t) for i, t in texts.items()}
    for nth in range(3):
        ids = sorted(prints)
        have, out, left = np.array([prints[i][nth] for i in ids], np.uint64), [], set(range(len(ids)))
        for k in range(len(ids)):
            reached = [k] if k in left else []
            out += [ids[x] for x in reached]
            left -= set(reached)
            for at in reached:
                near = left & set(np.flatnonzero(np.bitwise_count(have ^ have[at]) <= radius).tolist())
                left -= near
                reached += sorted(near)
        prints = {i: prints[i] for i in out}
    return set(prints)


def test_stages_take_effect(spark):
    """Each stage on what the stage before it kept, against what brute force keeps of that."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, d).cache()
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns
    assert all(i in kept for i, t in labels.items() if t == 0)
    assert sum(i in kept for i, t in labels.items() if t == 1) <= 0.2 * sum(t == 1 for t in labels.values())

    single = stage["simhash_near_dedup"](spark, clean, d).cache()
    least = plain_least({r["doc_id"]: r["text"] for r in clean.collect()}, simhash.STAGE_RADIUS)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(least)

    safe = stage["pii"](spark, single, d).cache()
    assert safe.columns == columns and safe.count() == single.count()
    left = pii.base_spans(safe).selectExpr("size(_email) + size(_ip) + size(_card) + size(_phone) as n").where("n > 0")
    assert left.isEmpty()

    mixed = stage["mixing"](spark, safe, d).cache()
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2

    packed = stage["packing"](spark, mixed, d)
    assert packed.columns == op5_packing(spark, d).columns
    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
