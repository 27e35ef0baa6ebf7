"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Bit i of a 64-bit fingerprint gets a non-zero vector f(i) of radius+1 bits. For each non-zero vector v, a mask keeps
the bits with an odd inner product of f(i) and v. The vectors of at most `radius` differing bits span a proper subspace,
so some v is orthogonal to all of them and its mask hides every differing bit: each pair within the radius agrees under
some mask, without exception (Pagh, "Locality-sensitive hashing without false negatives", 2016).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import keep
from corvane.llm.components import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
#: A stage of a pipeline drops near copies within this radius by one of so many fingerprints of their words of over SHORT characters.
STAGE_RADIUS, PRINTS, SHORT = 4, 3, 3
#: A bucket up to this size is compared within one task; larger ones take `_crowded_links`.
BUCKET = 20_000
_BLOCK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """Fingerprint of one text as an unsigned number: a bit is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), SEED)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + SHINGLE - 1]
        hashes = np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(SHINGLE)), strict=False)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def word_fingerprints_of(text: str | None) -> list[int]:
    """PRINTS fingerprints of the distinct words of a text, of seeds of their own: a bit is 1 if set in over half of the words' XXH64.

    Words of at most SHORT characters are left out, unless they are over half of the distinct ones, as in writing with
    spaces between syllables. An edit changes one word but up to five shingles, so near copies lie closer by their words;
    short words, which unlike texts share too, would bring those together. Without words all are 0.
    """
    words = set((text or "").encode().lower().split())
    long = [w for w in words if len(w) > SHORT and len(w.decode()) > SHORT]
    used, out = long if 2 * len(long) >= len(words) else list(words), []
    for seed in range(SEED, SEED + PRINTS):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(used), _BLOCK):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in used[at : at + _BLOCK]), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(used), bitorder="little").view(np.int64)[0]))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([word_fingerprints_of(t) for t in texts], dtype=object)


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, f in enumerate(vectors) if (f & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links a-b."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        while (jump := root[root] < root).any():
            root = np.where(jump, root[root], root)
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _crowd_roots(fp: np.ndarray, radius: int) -> np.ndarray:
    """As `_roots` for one bucket: each point is compared once with the points not yet reached."""
    root, left = np.full(len(fp), -1), np.arange(len(fp))
    while len(left):
        root[left[0]], queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            queue += list(left[near])
            root[left[near]], left = root[at], left[~near]
    return root


def _bucket_links(radius: int):
    """Over rows sorted by bucket: a star of links for each group of fingerprints connected within a bucket."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        new = np.ones(len(rows), bool)
        new[1:] = (rows["tab"].to_numpy()[1:] != rows["tab"].to_numpy()[:-1]) | (rows["bucket"].to_numpy()[1:] != rows["bucket"].to_numpy()[:-1])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        root, small = np.arange(len(rows)), (sizes[group] > 1) & (sizes[group] <= 64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(small)
        for shift in range(1, 64):
            at = at[at + shift < len(rows)]
            at = at[group[at] == group[at + shift]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
            found.append((near, near + shift))
        if found:
            root = _roots(len(rows), *(np.concatenate(x) for x in zip(*found, strict=True)))
        starts = np.flatnonzero(new)
        for g in np.flatnonzero(sizes > 64):
            lo, hi = starts[g], starts[g] + sizes[g]
            root[lo:hi] = lo + _crowd_roots(fp[lo:hi], radius)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return pd.DataFrame({"a": rep[root[moved]], "b": rep[moved]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows.iloc[-1] if len(rows) else None
            open_ = (rows["tab"] == last["tab"]) & (rows["bucket"] == last["bucket"]) if last is not None else []
            rest, rows = rows[open_].reset_index(drop=True), rows[~open_].reset_index(drop=True)
            if len(rows):
                yield links(rows)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _crowded_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links within crowded buckets, in time linear in their rows.

    Two fingerprints within the radius meet at a code that is at most radius//2 flips from one and radius - radius//2
    from the other, all among the bits that the mask hides. Where a code lies within radius//2 of some fingerprint, all
    fingerprints that reach it are within the radius of that one, so a star to the smallest loses no connection.
    """
    near, far = radius // 2, radius - radius // 2
    flips = []
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        flips.append([(_signed(sum(1 << i for i in c)), k) for k in range(far + 1) for c in combinations(free, k)])
    schema = "array<array<struct<flip:bigint,d:int>>>"
    by_table = F.from_json(F.lit("[" + ",".join("[" + ",".join(f'{{"flip":{x},"d":{k}}}' for x, k in t) + "]" for t in flips) + "]"), schema)
    reach = rows.select("tab", "rep", "fp", F.explode(F.get(by_table, F.col("tab"))).alias("x")).select("tab", F.col("fp").bitwiseXOR(F.col("x.flip")).alias("code"), "rep", "x.d")
    met = reach.groupBy("tab", "code").agg(F.min(F.when(F.col("d") <= near, F.col("rep"))).alias("centre"), F.count("*").alias("n")).where(f"centre is not null and n > 1")
    return reach.join(met, ["tab", "code"]).where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the `rep` of distinct fingerprints, with the same connected components as all pairs within the radius.

    nodes: (fp long, rep), one row for each fingerprint. Buckets are counted first; those over `bucket` rows never go to one task.
    """
    masks = covering_masks(radius)
    spread = nodes.select("rep", "fp", F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("tab", "mask")).select(F.col("tab").cast("int").alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp", "rep")
    crowded = keep(spread.groupBy("tab", "bucket").count().where(F.col("count") > bucket).select("tab", "bucket"))
    calm, hot = (spread, None) if crowded.isEmpty() else (spread.join(crowded, ["tab", "bucket"], "left_anti"), spread.join(crowded, ["tab", "bucket"], "left_semi"))
    links = calm.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket").mapInPandas(_bucket_links(radius), "a long, b long")
    return links if hot is None else links.unionByName(_crowded_links(hot, masks, radius))


def _named(prints: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(fp, component_id) of each fingerprint of (doc_id, fp) rows that have a doc_id.

    Fingerprints are linked as nodes of their own: a doc_id that is repeated with several of them links none.
    """
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    moved = components(near_links(nodes.select("fp", F.col("fp").alias("rep")), radius, bucket), "a", "b")
    roots = nodes.join(moved, nodes["fp"] == moved["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`: components of fingerprints linked within `radius` bits.

    Null and empty texts have fingerprint zero and link like any other; rows with a null doc_id take part, with the
    component of their fingerprint (null if no row with a doc_id is reachable). Repeated rows are all returned. An empty
    table gives an empty result. Other columns of `docs` are not read.
    """
    prints = keep(docs.select("doc_id", fingerprint("text").alias("fp")))
    return prints.join(_named(prints, radius, bucket), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """`docs` with one row for each group of near copies: that of the smallest doc_id, and among its rows of the least text hash.

    Groups are the components within the radius by the first of `word_fingerprints`; what they leave is grouped by the
    second, and so on, so that a pair that one fingerprint parts is met by another, and groups don't grow through chains
    of several kinds. Rows are told apart by doc_id and text, so rows that share a doc_id are judged each by its own
    text; equal ones leave one. Rows with a null doc_id stay. Null and empty texts are copies of each other. An empty
    table stays empty, and the columns of `docs`, whatever their names, stay as they are.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    prints = keep(docs.select("doc_id", word_fingerprints("text").alias("fps"), text_hash).where("doc_id is not null"))
    # equal texts are one row before anything is joined, and a group is its least row, summed up before the shuffle
    alive = keep(prints.groupBy("fps", "text_hash").agg(F.min("doc_id").alias("doc_id")))
    for nth in range(PRINTS):
        rows = alive.withColumn("fp", F.get("fps", F.lit(nth)))
        least = rows.join(_named(rows.select("doc_id", "fp"), radius, BUCKET), "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash", "fps")).alias("least"))
        alive = keep(least.select("least.*"))
    judged = prints.select("doc_id", "text_hash", F.lit(False).alias("stays")).unionByName(alive.select("doc_id", "text_hash", F.lit(True).alias("stays")))
    judged = keep(judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count_if(~F.col("stays")).alias("n")))
    # what is dropped grows with the corpus, so it is never broadcast: texts are dealt by doc_id and text, evenly
    dropped = judged.where("not stays").select(F.col("doc_id").alias("id"), "text_hash").hint("shuffle_merge")
    rest = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_hash).join(dropped, ["id", "text_hash"], "left_anti")
    if not judged.where("n > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("row"))
        rest = rest.where("id is not null").withColumn("nth", nth).where("nth = 1").drop("nth").unionByName(rest.where("id is null"))
    return rest.select("row.*")
