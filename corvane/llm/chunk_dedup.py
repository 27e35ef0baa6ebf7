"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text and depends on 16 bytes alone. A chunk ends where that hash is less than
at the REACH places on either side, so chunks vary in length, every cut depends on the bytes around it and nothing else,
and insertions shift no cut but those beside them (the local-extremum rule of Bjorner, Blass and Gurevich, 2010). From each
cut on, chunks are joined until they hold LEAST bytes; these runs are deduplicated by a 96-bit digest, so that a chance
collision is not to be expected in any corpus. What shares a digest has LEAST bytes or more in common, and two texts with a
common passage have the cuts within it in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import keep, table

#: log2 of the bytes that the hash spans, places on either side that a cut is compared with, greatest length of a chunk.
SPAN, REACH, MOST = 4, 12, 256
#: Bytes of a run at least, and of a repeated passage: so many words, or so many bytes where words are long.
LEAST, WORDS, BYTES = 100, 22, 300
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 9) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Runs that a task hands on at once, or those of one text if there are more.
PIECE = 100_000
CHUNKS = "doc_id long, text_hash int, start int, length int, word int, words int, again boolean, hi int, lo long"


def _gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 2**SPAN bytes from each place on."""
    h = GEAR[data]
    for j in range(SPAN):
        step = 1 << j
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h[(1 << SPAN) - 1 :]


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def cuts(data: bytes, reach: int = REACH, most: int = MOST) -> np.ndarray:
    """Places where chunks of `data` begin or end, from 0 to its length; the leftmost of equal hashes is the least."""
    inner = np.empty(0, np.int64)
    if len(data) >= (1 << SPAN) + 2 * reach:
        h = _gear(np.frombuffer(data, np.uint8))
        least = _least_of(h, reach)
        here = h[reach : len(h) - reach]
        inner = reach + np.flatnonzero((here < least[: len(here)]) & (here <= least[reach + 1 :][: len(here)]))
    ends = np.unique(np.concatenate([[0], inner, [len(data)]]))
    gap = np.diff(ends)
    if len(gap) and gap.max() > most:  # a run without a least place is cut by length from its last cut on
        ends = np.unique(np.concatenate([ends, *(np.arange(a, a + g, most) for a, g in zip(ends[:-1][gap > most], gap[gap > most], strict=True))]))
    return ends


def runs(data: bytes, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of chunks that are compared: from each cut on, the fewest chunks with `least` bytes."""
    at = cuts(data)
    to = np.searchsorted(at, at + least)
    fits = to < len(at)
    return at[fits], at[to[fits]]


def chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The compared runs of each text with their digests; `again` tells that an earlier run of the text has it.

    word is the number of words that begin before the run and words of those that begin in it. text_hash tells texts
    apart that share a doc_id. Rows with a null doc_id are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        joined = lambda parts: pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*parts, strict=True), strict=True)}, copy=False)
        for batch in batches:
            parts, n = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text or "").encode()
                start, end = runs(data, least)
                if not len(start):
                    continue
                space = _SPACE[np.frombuffer(data, np.uint8)]
                before = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                found = [digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                seen: set[bytes] = set()
                again = [x in seen or seen.add(x) is not None for x in found]
                text_hash = np.int64(xxhash.xxh32_intdigest(data)).astype(np.int32)
                halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                whole = lambda x, of=len(start): np.full(of, x)
                parts.append((whole(np.int64(doc_id)), whole(text_hash), *(x.astype(np.int32) for x in (start, end - start, before[start], before[end] - before[start])), np.array(again), halves[:, 0].astype(np.int32), halves[:, 1].copy()))
                n += len(start)
                if n >= PIECE:
                    yield joined(parts)
                    parts, n = [], 0
            if parts:
                yield joined(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInPandas(run, CHUNKS)


def _halves(docs: DataFrame, least: int) -> DataFrame:
    """The half `lo` of each digest of `chunks`, without what else is known of a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        joined = lambda parts: pd.DataFrame({"lo": np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)[:, 1]})
        for batch in batches:
            parts = []
            for text in batch["text"]:
                data = (text or "").encode()
                start, end = runs(data, least)
                parts += [digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                if len(parts) >= PIECE:
                    yield joined(parts)
                    parts = []
            yield joined(parts)

    return docs.where("doc_id is not null").select("text").mapInPandas(run, "lo long")


def repeated_chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs that stand in more than one document, or again in their own, with the smallest doc_id that has them, how many texts do, and which set.

    set_id is the same for all runs that the same texts share. First the half `lo` of each digest is counted, summed up
    before the shuffle; what occurs once is left out by a join, and the few that are left are summed up by whole digests
    and joined back. Both joins have one row for each key on one side, so Spark splits a very common one on the other.
    Texts are cut twice, for the count and for the join: that takes less disk than to write all runs down.
    """
    often = _halves(docs, least).groupBy("lo").agg(F.count("*").alias("n")).where("n > 1").select("lo")
    found = keep(chunks(docs, least).join(often, "lo"))
    once = F.when(~F.col("again"), F.xxhash64("doc_id", "text_hash"))
    sums = [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(once).alias("n_texts"), F.bit_xor(once).alias("set_id"), F.max("again").alias("twice")]
    shared = found.groupBy("hi", "lo").agg(*sums).where("first_id < last_id or twice").drop("last_id", "twice")
    return found.drop("again").join(shared, ["hi", "lo"])


def repeated_passages(docs: DataFrame, least: int = LEAST, words: int = WORDS, size: int = BYTES) -> DataFrame:
    """Passages that other documents, or the document itself, repeat: (doc_id, text_hash, start, end, n_words, n_bytes, n_chunks, first_id, n_texts, later, parts).

    start and end are bytes of the UTF-8 text, end exclusive; a passage is covered by repeated runs that touch, and has
    `words` words or `size` bytes at least. A common passage is found but for the bytes before its first and after its
    last cut, some 40 at either end. `parts` are its stretches that the same texts share, as (start, end, set_id, n_texts):
    two texts are linked if parts of theirs have a set_id in common, so no link is lost where a passage has many mates.
    first_id is the smallest doc_id that repeats a part of it, n_texts the most texts that share one (1 where it stands twice
    in its own document alone, with a row for each place), and later says that another document has it first. Null, empty and short texts have none; rows with a null doc_id are left out; equal rows
    are one text, and rows that share a doc_id are no repeats of each other. Columns besides doc_id and text are not read.
    """
    found = repeated_chunks(docs, least).select("doc_id", "text_hash", "start", "length", "word", "words", "first_id", "n_texts", "set_id").distinct()
    own = Window.partitionBy("doc_id", "text_hash")
    order = own.orderBy("start")
    rows = found.withColumn("end", F.col("start") + F.col("length")).withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("nth", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.col("nth") != F.lag("nth").over(order)
    changed = changed | (F.col("set_id") != F.lag("set_id").over(order))
    rows = rows.withColumn("part", F.count_if(F.coalesce(changed, F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = rows.groupBy("doc_id", "text_hash", "nth", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), F.max(F.col("word") + F.col("words")).alias("last_word"),
        F.count("*").alias("n_chunks"), F.min("first_id").alias("first_id"), F.first("n_texts").alias("n_texts"), F.first("set_id").alias("set_id"),
    )
    spans = stretch.groupBy("doc_id", "text_hash", "nth").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("word")).alias("n_words"), (F.max("end") - F.min("start")).alias("n_bytes"),
        F.sum("n_chunks").alias("n_chunks"), F.min("first_id").alias("first_id"), F.max("n_texts").alias("n_texts"),
        F.sort_array(F.collect_list(F.struct("start", "end", "set_id", "n_texts"))).alias("parts"),
    )
    return spans.drop("nth").where((F.col("n_words") >= words) | (F.col("n_bytes") >= size)).withColumn("later", F.col("first_id") < F.col("doc_id"))


def without_repeats(docs: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """`docs` without the passages that an earlier document has; the first to have one keeps it.

    Cuts move outwards to whole characters. Null texts stay null; columns and their order stay.
    """
    later = (repeated_passages(docs) if passages is None else passages).where("later")
    spans = keep(later.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans")))

    @F.pandas_udf("int")
    def text_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([xxhash.xxh32_intdigest((t or "").encode()) for t in batch], dtype="int64").astype("int32")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").alias("_id"), text_hash("text").alias("_hash"))
    rows = rows.join(spans.hint("shuffle_merge"), ["_id", "_hash"], "left").withColumn("_new", cut("text", "_spans"))
    return rows.select(*(F.col("_new").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    data, at, out = text.encode(), 0, []
    inside = lambda p: p < len(data) and data[p] & 0xC0 == 0x80  # noqa: E731  within a character
    for start, end in spans:
        while inside(start):
            start -= 1
        while inside(end):
            end += 1
        out.append(data[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode()


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of all documents that these or other documents repeat, as `repeated_passages` defines them; odd rows too."""
    return repeated_passages(table(spark, sf_dir, "documents"))
