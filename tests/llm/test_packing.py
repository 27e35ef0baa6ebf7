import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import packing
from corvane.llm.queries import op5_packing, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


def test_encoder_equals_tokenizers(encoder, spark, sf):
    odd = ["a   b", " a", "  a\n b", "x \n y", "", "\t a b ", "é    z", "a <|endoftext|> b", "it's  'tis 12 345x", "a\x1c b", "日本 語 test", "\U0001f600 ok", "Ünï ₿ ½ ²"]
    for text in odd + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]:
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, texts, encoder):
    """Every id of every document in one piece; sequences without gaps, at most 2048 long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids, at = [*encoder.encode(texts[doc_id] or ""), 1], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(by_sequence))


def test_query(spark, encoder):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert check(op5_packing(spark, d).collect(), texts, encoder) > 0.9


def test_sum_of_squares_equals_plain_search():
    rng = random.Random(4)
    lengths, size = [rng.randint(1, 40) for _ in range(400)], 40
    sequence, offset = packing.sum_of_squares(np.array(lengths), size)
    levels, fill = defaultdict(int), defaultdict(int)
    for s, q, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
        assert fill[q] == o

        def cost(level, s=s):
            after = dict(levels)
            if level:
                after[level] -= 1
            if level + s < size:
                after[level + s] = after.get(level + s, 0) + 1
            return sum(n * n for n in after.values())

        choices = [level for level in range(size - s + 1) if level == 0 or levels[level] > 0]
        assert cost(o) == min(map(cost, choices))
        if o:
            levels[o] -= 1
        fill[q] = o + s
        if o + s < size:
            levels[o + s] += 1


def test_little_waste():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 700, 30_000), 2047)
    sequence, _ = packing.sum_of_squares(lengths)
    assert lengths.sum() / (2048 * (sequence.max() + 1)) > 0.985


def test_odd_tables(odd_docs, no_docs, encoder):
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    one = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check([r for r in packing.pack(one, tokenizer_path()).collect()], {r["doc_id"]: r["text"] for r in one.collect()}, encoder)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_shards(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, tokenizer_path(), shard=50).collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, encoder)
    assert len({r["sequence_id"] >> 40 for r in rows}) > 3


def test_long_runs_of_white_space_are_encoded():
    """Its pattern recurses on them, so they never go to tiktoken; shorter runs give the same ids on both ways."""
    from corvane.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    for text in (" " * 4999 + "x", "a" + " \n\t" * 1666, " " * 20_000 + "b", "x" + "\u00a0" * 6000):
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.encode(" " * 1_000_000)) > 1000
