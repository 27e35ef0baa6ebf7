import random
import re

import numpy as np
import pytest

from corvane.llm import suffix_match as m

ITEMS = "item_id long, text string, row string"


def plain(docs, items, window):
    """Hit words and items of each text, by comparing every stretch of words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (of := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= of
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard,block", [(10**6, 10**6), (40, 10**6), (10**6, 60)])
def test_equals_plain_search(spark, shard, block):
    rng = random.Random(3)
    text = lambda n, k: " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))
    docs = [text(rng.randint(0, 60), k) for k in (1, 2, 3, 7) for _ in range(15)]
    items = [(i, text(rng.randint(0, 9), rng.choice((2, 3)))) for i in range(25)] + [(90, docs[40]), (91, docs[40]), (92, "zz " + docs[50][4:30]), (93, None), (94, "...")]
    rows = m.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(*x, "r") for x in items], ITEMS), window=4, shard=shard, block=block).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows}
    assert [got[i] for i in range(len(docs))] == plain(docs, items, 4)
    for r in rows:
        assert sum(b - a for a, b in r["spans"]) >= r["n_hit"] and (len(r["spans"]) > 0) == (r["n_hit"] > 0)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 500)
    key, depth = m.packed(words, 2)
    cut = lambda p: tuple(words[p : p + np.flatnonzero(np.append(words[p:], 0) == 0)[0]].tolist())[:40]
    order = m.suffix_array(words, key, depth, 40).tolist()
    assert sorted(order) == np.flatnonzero(words).tolist() and [cut(p) for p in order] == sorted(cut(p) for p in order)
    wide, depth = m.packed(words, 31)  # two words in a number, so that doubling has more to do
    assert [cut(p) for p in m.suffix_array(words, wide, depth, 40).tolist()] == sorted(cut(p) for p in order)


def test_longest_matches_and_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "x One, two three four! five six seven eight nine ten y", "k"), (2, f"q {passage} q", "k"), (3, "one two three", "k"), (4, None, "k")], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(7, "zero " + passage)], "item_id long, text string")
    best = {(r["item_start"]): (r["n_words"], r["doc_id"], r["start"]) for r in m.longest_matches(docs, bench).collect()}
    assert best[1] == (13, 2, 1)
    left = m.decontaminate(docs, bench)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.orderBy("doc_id").collect()] == [3, 4]


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two", "r"), (2, None, "r"), (None, "one", "r")], ITEMS)
    rows = odd_docs.withColumnsRenamed({"size": "found0", "code": "row"})
    found = m.matches(rows, bench).collect()
    assert len(found) == odd_docs.count() and all(r["items"] == ["1"] and r["n_hit"] == 2 for r in found if r["row"]["doc_id"] in (4, 5))
    assert m.decontaminate(rows, bench).columns == rows.columns
    assert m.matches(no_docs, bench).count() == 0
    nothing = m.matches(odd_docs, bench.where("false")).collect()
    assert len(nothing) == len(found) and all(r["n_hit"] == 0 and r["items"] == [] for r in nothing)


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 9973}" for i in range(400_000))  # 2.3 MB
    bench = [(1, " ".join(f"w{i}" for i in range(100, 130))), (2, "w1 w3 w5")]
    row = m.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()[0]
    assert (row["n_words"], row["n_hit"], row["items"]) == (400_000, 40 * 30 + (30 if 400_000 % 9973 >= 130 else 0), ["1"])
