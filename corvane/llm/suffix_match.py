"""Benchmark decontamination by suffix arrays over the training texts.

The words of the documents are laid end to end in shards. Each shard gets a suffix array: all places that begin with a word
of the benchmark, sorted by the words that follow, by prefix doubling up to the longest benchmark text (Manber and Myers,
1993; Larsson and Sadakane, 2007). Every suffix of every benchmark text is looked up in each array by binary search. The
places that share its window are hits; the search then goes on word by word until the longest verbatim match is known. Documents with
hits are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import keep, table

#: Words of a window; words of a shard at least, as long as its task has more; characters of a block of benchmark texts.
WINDOW, SHARD, BLOCK = 10, 2_000_000, 16_000_000
#: Bytes of a text as words see them: A-Z in lower case, letters, digits and all bytes of other characters stay, the rest is space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = "struct<start:int,n_words:int,item_id:string,item_start:int>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def packed(words: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """For each place the next words in one number, the first highest, zeros beyond the end; and how many words that are."""
    depth = max(1, 62 // bits)
    key, padded = np.zeros(len(words), np.int64), np.concatenate([words, np.zeros(depth, words.dtype)])
    for j in range(depth):
        key = key << bits | padded[j : j + len(words)]
    for j in range(1, depth):  # a zero ends a text: nothing behind it counts
        ended = padded[j : j + len(words)] == 0
        shift = bits * (depth - j)
        key[ended] = key[ended] >> shift << shift
    return key, depth


def suffix_array(words: np.ndarray, key: np.ndarray, depth: int, longest: int) -> np.ndarray:
    """Places of `words` that aren't zero, in the order of their first `longest` words or more, where a zero ends a text."""
    places = np.flatnonzero(words)
    order = places[np.argsort(key[places], kind="stable")]
    rank = np.zeros(len(words) + 1, np.int64)  # places of zeros, and what is beyond the end, come before all
    value, open_ = key[order], np.arange(len(order))  # open_: slots of the array whose order isn't known yet
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(order) else np.empty(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + 1
    while depth < longest:
        group = rank[order[open_]]
        alone = np.concatenate([[True], group[1:] != group[:-1], [True]])
        open_ = open_[~(alone[:-1] & alone[1:])]
        if not len(open_):
            break
        at = order[open_]
        # where a text has ended within `depth` words, it is equal to all of its group, and any order is right
        after = rank[np.minimum(at + depth, len(words))]
        sorted_ = np.lexsort((after, rank[at]))
        at, after = at[sorted_], after[sorted_]
        order[open_] = at
        group = rank[at]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        depth *= 2
    return order


def _bound(order: np.ndarray, key: np.ndarray, at: int, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First slot of each range [lo, hi) whose suffix has a key of `value` or more, `at` words on."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        below = key[np.minimum(order[mid] + at, len(key) - 1)] < value[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def narrowed(order: np.ndarray, key: np.ndarray, depth: int, bits: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [lo, hi) whose suffixes go on, `at` words on, with the first n words of the keys `wanted`."""
    shift = bits * (depth - n)
    low = wanted >> shift << shift
    return _bound(order, key, at, lo, hi, low), _bound(order, key, at, lo, hi, low + (1 << shift))


class Block:
    """Benchmark texts as word numbers, with their distinct windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, number = window, {}
        by_words: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            if words := words_of(text):
                by_words.setdefault(tuple(number.setdefault(w, len(number) + 1) for w in words), []).append(item)
        self.number, self.texts = number, sorted(by_words, key=lambda t: min(by_words[t]))
        self.items = [sorted(set(by_words[t])) for t in self.texts]  # texts of equal words are one
        self.bits = max(1, len(number).bit_length())
        ends = np.cumsum([len(t) + 1 for t in self.texts], dtype=np.int64)
        self.words = np.concatenate([np.array([*t, 0], np.int64) for t in self.texts] or [np.empty(0, np.int64)])
        self.text_of = np.repeat(np.arange(len(self.texts)), [len(t) + 1 for t in self.texts])
        self.start_of = ends - [len(t) + 1 for t in self.texts] if len(ends) else ends
        self.longest = max(map(len, self.texts), default=0)
        self.key, self.depth = packed(self.words, self.bits)
        # a window of each suffix that is long enough, and of each text that is shorter
        rest = (ends - 1)[self.text_of] - np.arange(len(self.words)) if len(ends) else np.empty(0, np.int64)
        first = np.arange(len(self.words)) == self.start_of[self.text_of] if len(ends) else np.empty(0, bool)
        self.suffixes = np.flatnonzero((rest >= window) | (first & (rest > 0)))
        self.needs = np.minimum(rest[self.suffixes], window)
        self.rest = rest[self.suffixes]

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hits of a shard: (place, suffix) of each place and window, the number of words of the suffix's longest match, and its place."""
        key, depth = packed(words, self.bits)
        order = suffix_array(words, key, depth, max(self.longest, self.window))
        lo, hi = np.zeros(len(self.suffixes), np.int64), np.full(len(self.suffixes), len(order), np.int64)
        at = 0
        while at < self.window and len(order):
            for n in np.unique(take := np.minimum(self.needs - at, depth)):
                if n > 0:
                    of = np.flatnonzero((take == n) & (lo < hi))
                    lo[of], hi[of] = narrowed(order, key, depth, self.bits, lo[of], hi[of], self.key[self.suffixes[of] + at], at, int(n))
            at += depth
        met = np.flatnonzero(lo < hi)
        length, place = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        length[met], place[met] = self.needs[met], order[lo[met]]
        # the longest match of each suffix: one word more, as long as some place has it
        a, b, open_ = lo.copy(), hi.copy(), met
        while (open_ := open_[length[open_] < self.rest[open_]]).size:
            for n in np.unique(length[open_]):
                of = open_[length[open_] == n]
                x, y = narrowed(order, key, depth, self.bits, a[of], b[of], self.key[self.suffixes[of] + n], int(n), 1)
                found = x < y
                a[of[found]], b[of[found]] = x[found], y[found]
                length[of[found]], place[of[found]] = n + 1, order[x[found]]
                length[of[~found]] |= 1 << 40  # done
            open_ = open_[length[open_] < 1 << 40]
        length &= (1 << 40) - 1
        counts = (hi - lo)[met]
        suffix = np.repeat(met, counts)
        slot = np.arange(len(suffix)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[suffix]
        return order[slot], suffix, length, place


def _shard(block: Block, batches: list[pa.RecordBatch], words: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a shard with the words, hits and items of each document, and its longest verbatim matches."""
    place, suffix, length, where = block.search(words)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts - 1
    doc = np.searchsorted(ends, place, "right")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + block.needs[suffix], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    n_hit = hit[ends] - hit[starts]
    pairs = np.unique(np.stack([doc, block.text_of[block.suffixes[suffix]]]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
    found: list[list[str]] = [[] for _ in range(n)]
    for d, t in pairs.T.tolist():
        found[d] += block.items[t]
    longest: list[list[dict]] = [[] for _ in range(n)]
    met = np.flatnonzero(length)
    # a suffix that only goes on with the match of the one before it says nothing new
    at = block.suffixes[met]
    goes_on = np.zeros(len(met), bool)
    goes_on[1:] = (at[1:] == at[:-1] + 1) & (length[met][1:] == length[met][:-1] - 1)
    for s in met[~goes_on].tolist():
        d = int(np.searchsorted(ends, where[s], "right"))
        t = int(block.text_of[block.suffixes[s]])
        longest[d].append({"start": int(where[s] - starts[d]), "n_words": int(length[s]), "item_id": block.items[t][0], "item_start": int(block.suffixes[s] - block.start_of[t])})
    spans = _spans(hit, starts, ends)
    out = [{"n_words": int(size[d]), "n_hit": int(n_hit[d]), "items": sorted(set(found[d])), "longest": longest[d], "spans": spans[d]} for d in range(n)]
    first = 0
    for batch in batches:
        new = pa.array(out[first : first + batch.num_rows], _FOUND)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], names=batch.schema.names)
        first += batch.num_rows


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[list[int]]]:
    """Stretches of hit words of each document, as [start, end) words."""
    is_hit = np.diff(hit) > 0
    step = np.diff(np.concatenate([[0], is_hit.astype(np.int8), [0]]))
    out: list[list[list[int]]] = [[] for _ in range(len(starts))]
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        d = int(np.searchsorted(ends, a, "right"))
        out[d].append([int(a - starts[d]), int(b - starts[d])])
    return out


_FOUND = pa.struct(
    [
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("longest", pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32())]))),
        ("spans", pa.list_(pa.list_(pa.int32()))),
    ]
)
FOUND = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,longest:array<{MATCH}>,spans:array<array<int>>>"


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about `size` characters, dealt by item_id, one at a time in the driver."""
    rows = keep(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(dealt == k).collect()]


def _found(block: Block, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = block.number.get
        held, parts, ends, at = [], [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
                parts.append(_ZERO)
                at += len(words) + 1
                ends.append(at)
            held.append(batch)
            if at >= shard:
                yield from _shard(block, held, np.concatenate(parts), np.array(ends))
                held, parts, ends, at = [], [], [], 0
        if held and ends:
            yield from _shard(block, held, np.concatenate(parts), np.array(ends))

    return run


_ZERO = np.zeros(1, np.int32)


def _joined(spans):
    """Words covered by the sorted `spans` of all blocks."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(x[1] - F.greatest(x[0], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x[1]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end")), step, lambda a: a["n"].cast("long"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(row, n_words, n_hit, items, longest, spans) of each row of `docs`, which comes back whole in the struct `row`.

    A window is `window` consecutive words of a benchmark text, or all words of a shorter one. `spans` are the stretches
    [start, end) of words within an occurrence of a window, n_hit their words, `items` the sorted ids (as strings) of
    all benchmark texts with an occurring window. `longest` has, for suffixes of benchmark texts, the longest verbatim
    match in the document's shard where it lies in this document: (start, n_words, item_id, item_start), counted in words;
    of texts with equal words the first id stands for all.

    Texts of any length are read whole, and a shard has whole documents. Null and empty texts on either side have no words;
    benchmark rows with a null item_id are left out; repeated rows each have their own row, and null doc_ids too. With no
    benchmark no word is hit; an empty table gives no row. The benchmark goes to the tasks in blocks of a bounded size,
    each of which reads the texts once more.
    """
    found = []
    rows = docs.select(F.struct("*").alias("row"), "text")
    for k, items in enumerate(blocks(benchmark, block)):
        found.append(f"found{k}")
        schema = rows.withColumn("found", F.lit(None).cast(FOUND)).schema
        rows = rows.withColumn("found", F.lit(None).cast(FOUND)).mapInArrow(_found(Block(items, window), shard), schema).withColumnRenamed("found", found[-1])
    one = F.col(found[0])
    if len(found) == 1:
        return rows.select("row", *(one[c].alias(c) for c in ("n_words", "n_hit", "items", "longest", "spans")))
    joined = lambda c: F.concat(*(F.col(f)[c] for f in found))
    spans = F.sort_array(joined("spans"))
    return rows.select("row", one["n_words"].alias("n_words"), _joined(spans).alias("n_hit"), F.sort_array(F.array_distinct(joined("items"))).alias("items"), joined("longest").alias("longest"), spans.alias("spans"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The longest verbatim match of each benchmark suffix over all shards: (item_id, item_start, n_words, doc_id, start)."""
    rows = matches(docs, benchmark, **options).select(F.col("row.doc_id").alias("doc_id"), F.explode("longest").alias("x")).select("doc_id", "x.*")
    best = F.max_by(F.struct("n_words", "doc_id", "start"), F.struct("n_words", -F.col("doc_id"), -F.col("start")))
    return rows.groupBy("item_id", "item_start").agg(best.alias("best")).select("item_id", "item_start", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that have a window of the benchmark; columns, whatever their names, and rows else stay."""
    return matches(docs, benchmark, **options).where("n_hit = 0").select("row.*")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of every document; odd rows as `matches` says."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
met AS (
  SELECT p.doc_id, p.i, p.size, item FROM (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(w)) p
  JOIN windows USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
