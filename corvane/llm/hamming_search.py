"""Exact top-k search over binary codes by incremental multi-index hashing, with DataFrame functions.

A code is cut into segments, and one index of (segment, value) holds all codes. If two codes differ in fewer than
segments * (r + 1) bits, they differ in at most r bits of some segment; so after radius r every code within
segments * (r + 1) - 1 bits has been met; and once the first s segments have radius r and the others r - 1, every code
within segments * r + s - 1 bits. All queries grow their radii together, round by round, and each leaves once that bound
covers the k-th best distance that it has verified (Norouzi, Punjani and Fleet, 2012).

A far query would need radii whose probes outnumber the codes. Such queries are compared with all codes instead, in blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import keep

BITS, TOP = 64, 10
#: Queries of a block that meet each code in one row.
BLOCK = 1000
#: Least and greatest bits of a segment; between them about one code for each value of a segment. Narrow segments need few
#: probes but meet a share of the index that grows with it.
NARROW, WIDE = 16, 22


def sign_code(vector: Column) -> Column:
    """64-bit code of a vector: bit i is 1 if element i is over zero; nulls, NaN and missing elements give 0.

    A vector of more than 64 elements is an error, as its code would leave some of them out.
    """
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.coalesce(vector, F.array().cast("array<float>")), bit)
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has over {BITS} elements")).cast("long")).otherwise(code)


def segments(codes: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of the segments for an index of so many codes; they differ by one bit at most."""
    n = -(-BITS // min(WIDE, max(NARROW, round(math.log2(max(codes, 2))))))
    ends = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(ends, ends[1:], strict=False)]


def _value(code: Column, segment: tuple[int, int]) -> Column:
    lo, width = segment
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def postings(codes: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """(seg, value, code, ids) of each segment of each code."""
    values = F.array(*(_value(F.col("code"), s) for s in cut))
    return codes.select("code", "ids", F.posexplode(values).alias("seg", "value"))


def rounds(segments: int, widest: int) -> list[tuple[int, int, range]]:
    """(least radius, radius, segments) of each round: small radii at once, large ones in halves of the segments."""
    half = segments // 2
    out = [(0, 1, range(segments)), (2, 2, range(segments))]  # radius 0 alone hardly settles a query
    for r in range(3, widest + 1):
        out += [(r, r, range(half)), (r, r, range(half, segments))]
    return out


def candidates(asked: DataFrame, index: DataFrame, cut: list[tuple[int, int]], least: int, radius: int, probed: range | None = None) -> DataFrame:
    """(query, id, distance) of codes that the `probed` segments meet at the radii from `least` to `radius`, and none before.

    A pair is met first at its least segment distance, and there in the first segment that has it. Where `asked` has the
    k-th distance of a query so far as `worst`, codes beyond it are left out, as they can be no result.
    """
    masks = lambda w: [sum(1 << i for i in c) for r in range(least, radius + 1) for c in combinations(range(w), r)]
    flips = {w: F.from_json(F.lit(str(masks(w))), "array<bigint>") for w in {w for _, w in cut}}

    def near(i: int) -> Column:
        own = _value(F.col("query"), cut[i])
        return F.transform(flips[cut[i][1]], lambda f: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(f).alias("value")))

    probe = [near(i) for i in (range(len(cut)) if probed is None else probed)]
    asked = asked if "worst" in asked.columns else asked.withColumn("worst", F.lit(BITS))
    probes = asked.select("query", "worst", F.explode(F.concat(*probe)).alias("p")).select("query", "worst", "p.*")
    # never broadcast: what a query asks for is many rows, and its size isn't known beforehand
    pairs = probes.join(index.hint("shuffle_merge"), ["seg", "value"]).withColumn("differ", F.col("query").bitwiseXOR(F.col("code")))
    pairs = pairs.where(F.bit_count("differ") <= F.col("worst")).withColumn("far", F.array(*(F.bit_count(_value(F.col("differ"), s)) for s in cut))).where(F.array_position("far", F.array_min("far")) == F.col("seg") + 1)
    return pairs.select("query", F.explode("ids").alias("id"), F.bit_count("differ").alias("distance"))


def probes(cut: list[tuple[int, int]], least: int, radius: int, probed: range) -> int:
    """How many probes a query makes in a round."""
    return sum(math.comb(cut[i][1], r) for i in probed for r in range(least, radius + 1))


def compared(asked: DataFrame, codes: DataFrame, n_asked: int, k: int) -> DataFrame:
    """(query, id, distance): the ids of each code within a query's k-th distance (`worst` of `asked`, if nearer), and no other.

    Every query of `asked` meets every code, a block of queries in one row. How many ids lie at each distance is summed up
    first, so that only the ids within the k-th distance are rows of their own.
    """
    blocks = -(-n_asked // BLOCK)
    dealt = keep(asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("query", "worst")).alias("asked")))

    def met(dealt: DataFrame) -> DataFrame:
        rows = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "block")
        near = F.filter("asked", lambda q: F.bit_count(q["query"].bitwiseXOR(F.col("code"))) <= q["worst"])
        rows = rows.select("code", "ids", F.explode(near).alias("q"))
        return rows.select("ids", "q.query", F.bit_count(F.col("q.query").bitwiseXOR(F.col("code"))).alias("distance"))

    so_far = F.sum("n").over(Window.partitionBy("query").orderBy("distance"))
    reached = met(dealt).groupBy("query", "distance").agg(F.sum(F.size("ids")).alias("n")).withColumn("n", so_far).where(F.col("n") >= k)
    kth = reached.groupBy("query").agg(F.min("distance").alias("kth"))
    asked = asked.join(kth, "query", "left").select("query", F.least("worst", "kth").alias("worst"))
    dealt = keep(asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("query", "worst")).alias("asked")))
    return met(dealt).select("query", F.explode("ids").alias("id"), "distance")


def top_k(queries: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """The k codes of `index` nearest to each code of `queries`: (query_id, id, distance, rank), ties by id.

    Both have (id, code long). Rows with a null id or code take no part, and fewer than k rows are returned only where
    the index has fewer. Of the ids that share a code only the k smallest can be results, so each code keeps those; they
    are found before the shuffle, and a very common code gathers nowhere. Queries with equal codes are searched once. Each
    round joins the probes of the open queries with the one index and keeps k rows for each query, so what is carried on
    doesn't grow; every round is a written table. Once a query would make more probes in a round than there are codes, the
    open queries are compared with all codes (`compared`), which ends the search. An empty table on either side gives no row.
    """
    by_id = Window.partitionBy("code").orderBy("id")
    kept = index.where("id is not null and code is not null").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k)
    codes = keep(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    n, held = codes.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    cut, tasks = segments(n), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    have = keep(postings(codes, cut))
    # few queries make many probes, so they are dealt to a fixed number of tasks
    open_ = keep(asked.select("query", F.lit(BITS).alias("worst")).distinct().repartition(tasks, "query"))
    best = open_.select("query", F.lit(0).cast("long").alias("id"), F.lit(0).alias("distance")).where("false")
    order = Window.partitionBy("query").orderBy("distance", "id")
    for least, radius, probed in rounds(len(cut), max(w for _, w in cut)):
        left = open_.count() if n else 0
        if not left:
            break
        if probes(cut, least, radius, probed) > n:
            settled = best.join(open_.select("query"), "query", "left_anti").select("query", "id", "distance")
            met = settled.unionByName(compared(open_, codes, left, k))
            best = keep(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            break
        met = best.select("query", "id", "distance").unionByName(candidates(open_.repartition(tasks, "query"), have, cut, least, radius, probed))
        best = keep(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        covered = len(cut) * radius + probed[-1]
        last = best.where(F.col("rank") == min(k, held)).select("query", F.col("distance").alias("last"))
        open_ = open_.join(last, "query", "left").withColumn("worst", F.coalesce("last", "worst"))
        open_ = keep(open_.where(F.col("last").isNull() | (F.col("last") > covered)).select("query", "worst"))
    found = best if "rank" in best.columns else best.withColumn("rank", F.lit(0))
    return asked.join(found, "query").select("query_id", "id", "distance", "rank")
