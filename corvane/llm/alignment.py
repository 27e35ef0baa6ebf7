"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes. All tokens of both are sorted by start; a running maximum of their ends tells where a
start reaches all that came before, and there the groups break: the least stretches that both cut alike. Within them,
every pair of overlapping tokens is a link. How many documents link a pair of ids is counted over the corpus.

A block is as many whole documents as hold BLOCK tokens. It keeps its distinct pairs once, so the corpus counts are summed
up from blocks, and each block asks for the counts of its own pairs only: neither the links of a document nor the table of
all pairs meets in one place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import packing
from corvane.llm.common import keep, table

#: Tokens of the first tokenizer after which a block ends, with a whole document.
BLOCK = 600_000
_SEPARATORS = ("", ",", "|", ";")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, at array<int>, times array<int>, pairs array<bigint>, held array<int>"


class ByteLevel(packing.Encoder):
    """Ids by a byte-level vocabulary, strings of special tokens being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    def ids(self, text: str) -> np.ndarray:
        if packing._OTHER(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        known = {i: b for b, i in self.fast._mergeable_ranks.items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [known.get(i, (self.tokenizer.id_to_token(i) or "").encode()) for i in range(size)]


class Pieces:
    """Ids by a sentencepiece model, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        model = self.model
        piece = lambda i: model.id_to_piece(i)
        return [bytes([int(piece(i)[3:5], 16)]) if model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, both in order of their places; equal stretches of bytes are covered by both."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.concatenate([[0], start[order][1:] >= reach[:-1]])) if len(start) else 0
    return group[: len(start_a)], group[len(start_a) :]


def links(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A, B) token numbers whose places overlap: those of B that end behind a token's start and start before its end."""
    lo, hi = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = hi - lo
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + lo[a]


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _aligned(path_a: str, path_b: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = ByteLevel(path_a), Pieces(path_b)
        bytes_a, bytes_b = a.bytes_of, b.bytes_of
        size_a, size_b = (np.array([len(x) for x in y], np.int32) for y in (bytes_a, bytes_b))
        text_of = [f"{i}{s}" for i in range(max(len(bytes_a), len(bytes_b))) for s in _SEPARATORS]
        none = np.empty(0, np.int32)

        def encoded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            if not text:
                return none, none
            data, ids_a, ids_b = b" " + text.encode(), a.ids(" " + text), b.ids(text)
            for ids, known in ((ids_a, bytes_a), (ids_b, bytes_b)):
                if b"".join(map(known.__getitem__, ids.tolist())) != data:
                    return none, none
            return ids_a, ids_b

        def rows(doc_ids: list, docs: list[tuple[np.ndarray, np.ndarray]], number: int) -> Iterator[pa.RecordBatch]:
            n = len(docs)
            n_a, n_b = (np.array([len(d[k]) for d in docs], np.int64) for k in (0, 1))
            ids_a, ids_b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
            # documents laid end to end: both tokenizers cover the same bytes of each
            end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
            place = (end_a - size_a[ids_a], end_a, end_b - size_b[ids_b], end_b)
            group_a, group_b = coalesced(*place)
            link_a, link_b = links(*place)
            del place
            doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
            n_groups = np.bincount(doc_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=n)
            n_links = np.bincount(doc_a[link_a], minlength=n)
            # the groups as text: ids in the order of group, side and place, each with what parts it from the next
            side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
            key = np.concatenate([group_a, group_b]) * 2 + side
            order = np.argsort(key, kind="stable")
            key, doc = key[order], np.concatenate([doc_a, doc_b])[order]
            step = np.where(key[1:] == key[:-1], 1, np.where(key[1:] >> 1 == key[:-1] >> 1, 2, 3))
            step = np.append(np.where(doc[1:] == doc[:-1], step, 0), 0)[: len(key)]
            del side, group_a, group_b
            shown = np.concatenate([ids_a, ids_b])[order] * 4 + step
            to = np.cumsum(n_a + n_b).tolist()
            groups = ["".join(map(text_of.__getitem__, shown[x:y].tolist())) for x, y in zip([0, *to], to, strict=False)]
            # distinct pairs of each document, as numbers in the block's list of distinct pairs
            codes = len(bytes_a) * len(bytes_b)
            del shown, key, order, doc, step
            pair, times = np.unique(doc_a[link_a] * codes + ids_a[link_a].astype(np.int64) * len(bytes_b) + ids_b[link_b], return_counts=True)
            known, at, held = np.unique(pair % codes, return_inverse=True, return_counts=True)
            ends = np.cumsum(np.bincount(pair // codes, minlength=n))
            longs = lambda x: pa.array(x, pa.int64())
            empty = lambda kind: pa.nulls(n, pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [longs(doc_ids), longs(n_a), longs(n_b), longs(n_groups), longs(n_links), pa.array(groups, pa.string()), longs(np.full(n, number)), _lists(at, ends, pa.int32()), _lists(times, ends, pa.int32()), empty(pa.int64()), empty(pa.int32())],
                names=_NAMES,
            )
            if len(known):
                one = np.array([len(known)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), longs([number]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), _lists(known, one, pa.int64()), _lists(held, one, pa.int32())],
                    names=_NAMES,
                )

        doc_ids, docs, have, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(encoded(text))
                doc_ids.append(doc_id)
                have += len(docs[-1][0])
                if have >= block:
                    yield from rows(doc_ids, docs, number)
                    doc_ids, docs, have, number = [], [], 0, number + 1
        if docs:
            yield from rows(doc_ids, docs, number)

    return run


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "at", "times", "pairs", "held"]


def aligned(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Rows of documents, and with `pairs` a row of each block of them.

    A document has n_a, n_b, n_groups, n_links, and `groups` as `a1,a2|b1;a3|b2,b3` (decimal ids in order). `at` are the
    places of its distinct linked pairs of ids in the list `pairs` of its block (a pair is a * size of B's vocabulary + b),
    `times` how often each is linked. The row of a block has doc_id null and with each pair the number of its documents
    that hold it, `held`.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(path_a, path_b, block), ALIGNED)


def _scored(key, found: pa.Table, counts: pa.Table) -> pa.Table:
    n = np.zeros(counts.num_rows, np.int64)
    best = np.zeros(counts.num_rows, bool)
    at = counts.column("i").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    lists = [found.column(c).combine_chunks() for c in ("at", "times")]
    ends = np.cumsum(np.concatenate([[0], lists[0].value_lengths().to_numpy()]))
    pair, times = (x.flatten().to_numpy() for x in lists)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[pair], times * n[pair])]
    new = [pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in sums]
    return pa.table([*(found.column(c) for c in _KEPT), *new], names=[*_KEPT, "n_best", "count_sum"])


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(a, b, pair, n, best): documents that hold each linked pair of ids, and whether no pair of that A id has more."""
    held = found.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    held = held.select("pair", "n", F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"))
    most = held.groupBy("a").agg(F.max("n").alias("most"))
    return held.join(most, "a").select("a", "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of `docs`.

    Space and text are cut by a byte-level vocabulary (A), the text by a sentencepiece model (B), which adds the space.
    Where the bytes of either's tokens aren't those of space and text, and where the text is null or empty, there are
    no tokens: zeros, and '' for groups_sha256. n_best counts the links whose pair is held by the most documents of all
    pairs with its A id (ties included), count_sum adds up the counts of all links. Texts of any length are read whole;
    repeated rows each count as a document and have a row, null doc_ids too; an empty table gives no row. Columns besides
    doc_id and text are not read.
    """
    found = aligned(docs, path_a, path_b, block)
    found = keep(found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"))
    counts = keep(pair_counts(found, Pieces(path_b).model.get_piece_size()).select("pair", "n", "best"))
    asked = found.where("pairs is not null").select("block", F.posexplode("pairs").alias("i", "pair"))
    answers = asked.join(counts, "pair").select("block", "i", "n", "best")
    rows = found.where("at is not null").select(F.col("block").alias("of"), *_KEPT, "at", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(_scored, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document by the two public vocabularies; odd rows as `align` says."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
