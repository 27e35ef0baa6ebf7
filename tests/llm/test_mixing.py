import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing


def brute_targets(sizes):
    """sizes: [(source, size)], sources in order."""
    weights = [[3, 1, 2][i % 3] for i in range(len(sizes))]
    left, open_, target = 1.5 * sum(s for _, s in sizes), set(range(len(sizes))), {}
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * sizes[i][1]}
        if not over:
            target |= share
            break
        for i in over:
            target[i], left = 2.0 * sizes[i][1], left - 2 * sizes[i][1]
        open_ -= over
    return {sizes[i][0]: t for i, t in target.items()}


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 100), ("c", 100)], [("a", 1), ("b", 1000), ("c", 10), ("d", 500), (None, 90)], [("a", 7)], [("a", 0), ("b", 10)], [("a", 5), ("b", 5), ("c", 5), ("d", 5000)]])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r["source"]: r["target"] for r in rows} == {k: pytest.approx(v) for k, v in want.items()}


def test_query(spark):
    from corvane.llm.queries import op8_mixing

    d = "/root/testdata/sf0.1"
    rows = op8_mixing(spark, d)
    assert all(r["taken"] <= 2 * r["size"] for r in rows.collect())
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    per = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 20 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in per)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, op8_mixing(spark, d).collect()))


def test_mix_agrees_with_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect() if r["copies"]}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_odd_tables(odd_docs, no_docs):
    rows = mixing.plan(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("copies is null or target is null").count() == 0
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_keeps_columns_of_any_name(odd_docs):
    names = dict(zip(("component", "score", "code", "size", "n_chars"), ("_copy", "whole", "row", "s", "seed"), strict=True))
    rows = odd_docs.withColumnsRenamed(names)
    out = mixing.mix(rows)
    assert out.columns == rows.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows.collect()}
    more = odd_docs.withColumnsRenamed(dict(zip(names, ("copy", "part", "_whole", "_part", "_seed"), strict=True)))
    assert mixing.mix(more).columns == more.columns and mixing.mix(more).count() == out.count()
