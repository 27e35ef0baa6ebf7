import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import chunk_dedup, hamming_search


def brute(queries, index, k):
    return {(q, *x, r + 1) for q, qc in queries for r, x in enumerate(sorted((((qc ^ c) & (2**64 - 1)).bit_count(), i) for i, c in index)[:k])}


@pytest.mark.parametrize("spread", [64, 6, 0])
def test_top_k_is_exact(spark, spread):
    """Uniform codes, close families, and one code that most rows share."""
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(5)]
    code = lambda: rng.getrandbits(64) if spread == 64 else centres[rng.randrange(5)] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread)))
    rows = [(i, code()) for i in range(700)]
    signed = spark.createDataFrame([(i, c - 2**64 if c >= 2**63 else c) for i, c in rows], "id long, code long")
    out = hamming_search.top_k(signed.where("id % 50 = 0"), signed, k=7).collect()
    assert {(r["query_id"], r["distance"], r["id"], r["rank"]) for r in out} == brute([x for x in rows if x[0] % 50 == 0], rows, 7)


@pytest.mark.parametrize("shared", [False, True])
def test_far_queries_are_compared_with_all_codes(spark, shared):
    """Queries 60 bits from everything, beside near ones; ids that share codes, more queries than a block, ties at the k-th distance."""
    rng = random.Random(5)
    rows = [(i, sum(1 << b for b in rng.sample(range(64), 2 if i % 2 else 3))) for i in range(600)] + [(i, 7) for i in range(600, 640 if shared else 600)]
    asked = [(1000 + i, (2**64 - 1) ^ sum(1 << b for b in rng.sample(range(64), i % 3))) for i in range(40)] + [(2000, 7), (2001, rows[3][1])]
    frame = lambda x: spark.createDataFrame([(i, c - 2**64 if c >= 2**63 else c) for i, c in x], "id long, code long")
    kept, hamming_search.BLOCK = hamming_search.BLOCK, 9
    try:
        out = hamming_search.top_k(frame(asked), frame(rows), k=7).collect()
    finally:
        hamming_search.BLOCK = kept
    assert {(r["query_id"], r["distance"], r["id"], r["rank"]) for r in out} == brute(asked, rows, 7)
    few = hamming_search.top_k(frame(asked), frame(rows[:5]), k=7).collect()
    assert {(r["query_id"], r["distance"], r["id"], r["rank"]) for r in few} == brute(asked, rows[:5], 7)


def test_sign_code_and_nulls(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [])], "id long, v array<float>")
    coded = rows.select("id", hamming_search.sign_code(F.col("v")).alias("code"))
    assert {r["id"]: r["code"] for r in coded.collect()} == {1: 0b1001, 2: 0, 3: 0b10, 4: 0}
    wide = spark.createDataFrame([(1, [1.0] * 64)], "id long, v array<float>").select(hamming_search.sign_code(F.col("v")).alias("c")).first()["c"]
    assert wide == -1
    assert hamming_search.top_k(coded, coded.where("id < 0")).count() == 0 and hamming_search.top_k(coded.where("id < 0"), coded).count() == 0
    odd = coded.unionByName(spark.createDataFrame([(None, 1), (9, None)], "id long, code long"))
    assert hamming_search.top_k(odd, odd).count() == 16


def test_wide_vectors_are_refused(spark):
    wide = spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<float>")
    with pytest.raises(Exception, match="over 64 elements"):
        wide.select(hamming_search.sign_code(F.col("v"))).collect()


def test_each_candidate_is_met_once_and_few_are(spark):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(64) - 2**63) for i in range(3000)]
    codes = spark.createDataFrame([(c, [i]) for i, c in rows], "code long, ids array<long>")
    cut = hamming_search.segments(len(rows))
    index, asked = hamming_search.postings(codes, cut), spark.createDataFrame([(rows[k][1],) for k in range(5)], "query long")
    met = [[(r["query"], r["id"]) for r in hamming_search.candidates(asked, index, cut, radius, radius).collect()] for radius in range(17)]
    assert len({x for part in met for x in part}) == sum(map(len, met)) == 5 * len(rows)
    assert sum(map(len, met[:4])) < 0.1 * 5 * len(rows)  # these radii cover 15 bits


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, 200)) for i in range(60)]
    for p in range(15):  # a passage of 55 words in two documents, at different places
        passage, (i, a), (j, b) = words(rng, 55), docs[2 * p], docs[2 * p + 1]
        docs[2 * p] = (i, a[: 100 + p] + " " + passage + " " + a[100 + p :])
        docs[2 * p + 1] = (j, b + " " + passage)
    out = chunk_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == set(range(30))
    texts = dict(docs)
    for r in out:
        mate = texts[r["doc_id"] ^ 1].encode()
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]] in mate and r["first_id"] == r["doc_id"] & ~1 and r["later"] == bool(r["doc_id"] & 1)


def planted(n, seed=11):
    """Documents 2i and 2i + 1 share only a passage of 51 words of a document of the tables; (rows, passages in UTF-8)."""
    rng, rows, passages = random.Random(seed), [], []
    texts = [t.split() for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].dropna()]
    texts = [t for t in texts if len(t) > 51]
    while len(passages) < n:
        t = rng.choice(texts)
        at = rng.randrange(len(t) - 51)
        if len(set(t[at : at + 51])) < 31:
            continue
        passage = " ".join(t[at : at + 51])
        rows += [(2 * len(passages) + k, f"{words(rng, 40)} {passage} {words(rng, 40)}") for k in range(2)]
        passages.append(passage.encode())
    return rows, passages


def test_passages_of_51_words_are_found(spark):
    rows, passages = planted(3000)
    out = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {r["doc_id"] for r in out}
    assert len(found) >= 0.998 * len(rows), len(found) / len(rows)


def test_repeats_within_a_text_are_found(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    text = " ".join(f"{words(rng, 30)} {passage}" for _ in range(5))
    out = chunk_dedup.repeated_passages(spark.createDataFrame([(1, text), (2, words(rng, 300)), (3, passage)], "doc_id long, text string").where("doc_id < 3")).collect()
    assert [r["doc_id"] for r in out] == [1] * 5 and all(not r["later"] and r["n_texts"] == 1 for r in out)
    assert all(text.encode()[r["start"] : r["end"]].decode() in passage for r in out)


def plain_cuts(data):
    """Cuts by their definition."""
    n, reach = len(data) - 15, chunk_dedup.REACH
    h = [sum(int(chunk_dedup.GEAR[data[p + k]]) << (15 - k) for k in range(16)) % 2**32 for p in range(max(0, n))]
    inner = [p for p in range(reach, n - reach) if all(h[p] < x for x in h[p - reach : p]) and all(h[p] <= x for x in h[p + 1 : p + reach + 1])]
    out = [0]
    for p in [*inner, len(data)]:
        while p - out[-1] > chunk_dedup.MOST:
            out.append(out[-1] + chunk_dedup.MOST)
        out += [p] * (p > out[-1])
    return out


def plain_runs(data):
    at = plain_cuts(data)
    ends = [next((b for b in at if b - a >= chunk_dedup.LEAST), None) for a in at]
    return [(a, b) for a, b in zip(at, ends) if b is not None]


def test_cuts_equal_their_definition():
    rng = random.Random(6)
    for n in range(60):
        letters = ["ab", "abcdefghijklmnop ", "a"][n % 3]
        data = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 39, 40, 41, 300, 900]))).encode()
        assert chunk_dedup.cuts(data).tolist() == sorted({*plain_cuts(data)})


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    having, places = {}, {}
    for d, data in texts.items():
        for a, b in plain_runs(data):
            having.setdefault(data[a:b], set()).add(d)
            places.setdefault((d, data[a:b]), []).append(a)
    twice = {run for (_, run), at in places.items() if len(at) > 1}
    want = set()
    for d, data in texts.items():
        open_ = None
        for a, b in [*((a, b) for a, b in plain_runs(data) if len(having[data[a:b]]) > 1 or data[a:b] in twice), (10**9, 10**9)]:
            if open_ and a > open_[1]:
                words = sum(1 for p in range(*open_[:2]) if not data[p : p + 1].isspace() and (p == 0 or data[p - 1 : p].isspace()))
                if words >= chunk_dedup.WORDS or open_[1] - open_[0] >= chunk_dedup.BYTES:
                    want.add((d, *open_[:2], words, min(open_[2]), max(open_[3])))
                open_ = None
            mates = having.get(data[a:b], {d})
            open_ = (open_[0], max(open_[1], b), open_[2] | mates, open_[3] | {len(mates)}) if open_ else (a, b, mates, {len(mates)})
    rows = chunk_dedup.op2_substring_dedup(spark, sf).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["n_words"], r["first_id"], r["n_texts"]) for r in rows} == want and len(rows) == len(want) > 10
    # two documents have a set in common exactly if they have a run in common, where both are reported
    linked = {(x, y) for docs in having.values() for x in docs for y in docs if x < y}
    sets = {}
    for r in rows:
        for part in r["parts"]:
            sets.setdefault(part["set_id"], set()).add(r["doc_id"])
    found = {(x, y) for docs in sets.values() for x in docs for y in docs if x < y}
    assert found <= linked and all(len(texts[x]) and len(texts[y]) for x, y in found) and len(found) > 10


def test_all_mates_of_a_passage_are_linked(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, f"{a} {b} {c}"), (2, f"{words(rng, 30)} {a} {b}"), (3, f"{b} {words(rng, 40)}"), (4, f"{words(rng, 9)} {c}")]
    out = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {d: {p["set_id"] for r in out if r["doc_id"] == d for p in r["parts"]} for d in (1, 2, 3, 4)}
    assert {(x, y) for x in sets for y in sets if x < y and sets[x] & sets[y]} == {(1, 2), (1, 3), (1, 4), (2, 3)}
    assert max(r["n_texts"] for r in out if r["doc_id"] == 1) == 3


def test_removal(spark, odd_docs, no_docs):
    rng = random.Random(13)
    passage = words(rng, 70)
    rows = [(1, f"{words(rng, 30)} {passage}", "k"), (2, f"é {passage} end", "l"), (3, None, "m"), (4, "short", "n")]
    out = {r["doc_id"]: r for r in chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] is None and out[4]["text"] == "short" and out[2]["row"] == "l"
    assert out[2]["text"].startswith("é ") and out[2]["text"].endswith(" end") and len(out[2]["text"]) < 90
    same = chunk_dedup.without_repeats(odd_docs)
    assert same.columns == odd_docs.columns and same.count() == odd_docs.count() and chunk_dedup.without_repeats(no_docs).count() == 0


def test_a_run_of_one_letter_and_texts_that_share_an_id(spark):
    rng = random.Random(14)
    passage = words(rng, 80)
    rows = [(1, words(rng, 20) + "a" * 5000), (2, "b" + "a" * 4999), (5, passage + words(rng, 300)), (5, words(rng, 200) + passage), (6, passage)]
    out = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 5, 6}
    assert all(r["n_bytes"] <= len(passage) for r in out if r["doc_id"] in (5, 6)) and sum(r["doc_id"] == 5 for r in out) == 2


def test_cuts_shift_with_their_content():
    rng = random.Random(8)
    a = words(rng, 400).encode()
    at = len(a) // 2
    before, after = set(chunk_dedup.cuts(a).tolist()), set(chunk_dedup.cuts(a[:at] + b"inserted" + a[at:]).tolist())
    assert {c for c in before if c < at - 40} <= after and {c + 8 for c in before if c > at + 40} <= after
    assert chunk_dedup.cuts(b"").tolist() == [0] and chunk_dedup.cuts(b"ab").tolist() == [0, 2]


def test_exact_copies_and_odd_tables(spark, odd_docs, no_docs):
    out = chunk_dedup.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in out} == {6, 7}
    assert chunk_dedup.repeated_passages(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "some words that repeat within one document only. " * 20)], "doc_id long, text string")
    out = chunk_dedup.repeated_passages(rows.unionByName(rows)).collect()
    assert len(out) == 1 and not out[0]["later"]  # what repeats within the text is one stretch; an equal row is no other text
    once = spark.createDataFrame([(1, words(random.Random(1), 200))], "doc_id long, text string")
    assert chunk_dedup.repeated_passages(once.unionByName(once)).count() == 0
