"""Phrase collocations by vertical partitioning of a suffix tree, as ERA does (Mansour, Allam, Skiadopoulos and Kalnis, 2011).

Each word begins a suffix of its piece, cut off at DEPTH words. Prefixes of suffixes are grouped so that each group's
suffixes fit a memory budget: a word is a prefix of its own, one with more suffixes than the budget is split by its next
word, and such a pair by the whole suffix. The suffixes of a group go to one task, which sorts them, so that its subtree
lies in the order of its leaves; the count of a node is the total of the leaves below it. Groups don't depend on each other.

Tasks that read texts send the suffixes of a group as one packed row of distinct suffixes with their counts, so that what
is repeated within a task is shuffled once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import keep, table

#: Words of a suffix at most, occurrences of a phrase at least, phrases of a language that are reported.
DEPTH, LEAST, TOP = 4, 30, 2000
#: Suffixes of a group, more or less; and the most groups, so that what is broadcast about prefixes has a bound.
BUDGET, GROUPS = 1 << 20, 1 << 16
#: Words of texts after which a task sends what it has.
FLUSH = 4_000_000
#: Bytes as the splitting sees them: A-Z in lower case, separators of pieces as a byte that no text has, tabs as spaces.
_BREAK = b"\xff"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
SUFFIXES = "group long, lang string, words array<binary>, suffixes binary, counts binary"


def tokens(text: str | None) -> list[bytes]:
    """Words of all pieces, with a break between pieces."""
    return [w for w in (text or "").encode().translate(_BYTES).replace(_BREAK, b" \xff ").split(b" ") if w]


class _Numbers(dict):
    """Numbers of words from 1 on, as they come; a break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _by_lang(batches: Iterator[pd.DataFrame], flush: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, numbers) of texts laid end to end with breaks between them, at most about `flush` words at a time."""
    numbers, parts, have = defaultdict(_Numbers), defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words = tokens(text)
            if words:
                words.append(_BREAK)
                parts[lang].append(np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words)))
                have += len(words)
            if have >= flush:
                for of in parts:
                    yield of, list(numbers[of]), np.concatenate(parts[of])
                numbers, parts, have = defaultdict(_Numbers), defaultdict(list), 0
    for of in parts:
        yield of, list(numbers[of]), np.concatenate(parts[of])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(lang, word, n) of all words; tasks send each of their words once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, numbers in _by_lang(batches, flush):
            n = np.bincount(numbers, minlength=len(words))
            yield pd.DataFrame({"lang": lang, "word": [w.decode() for w in words[1:]], "n": n[1:]})

    return _texts(docs).mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, heavy: dict[tuple[str, bytes], int], flush: int) -> DataFrame:
    """(lang, first, word, n) of the pairs that begin with a word of `heavy`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, numbers in _by_lang(batches, flush):
            split = np.array([(lang, w) in heavy for w in words])
            at = np.flatnonzero(split[numbers[:-1]] & (numbers[1:] > 0))
            pair, n = np.unique(numbers[at].astype(np.int64) << 32 | numbers[at + 1], return_counts=True)
            if len(pair):
                yield pd.DataFrame({"lang": lang, "first": [words[p >> 32].decode() for p in pair], "word": [words[p & 0xFFFFFFFF].decode() for p in pair], "n": n})

    return _texts(docs).mapInPandas(run, "lang string, first string, word string, n long").groupBy("lang", "first", "word").agg(F.sum("n").alias("n"))


#: Odd multipliers that mix the hashes of a suffix's words.
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(bytes([k])) | 1) for k in range(16)]


class Partition:
    """Groups of prefixes: large words are packed into groups by size, others are dealt by hash; `heavy` prefixes are split."""

    def __init__(self, n: int, words: list[tuple[str, str, int]], budget: int):
        self.budget, self.groups = budget, max(1, -(-n // budget))
        load, self.packed = np.zeros(self.groups, np.int64), {}
        self.heavy = {(lang, w.encode()): k for lang, w, k in words if k > budget}
        load += (n - sum(k for _, _, k in words)) // self.groups
        for lang, w, k in sorted(words, key=lambda x: (-x[2], x[0], x[1])):
            if k <= budget:
                at = int(load.argmin())
                load[at] += k
                self.packed[lang, w.encode()] = at
        self.heavy_pairs: set[tuple[str, bytes, bytes]] = set()

    def group_of(self, lang: str, words: list[bytes], rows: np.ndarray) -> np.ndarray:
        """Group of each row of word numbers (suffixes of DEPTH words, zeros at their ends)."""
        first = np.unique(rows[:, 0])
        by_word = np.zeros(len(words), np.int64)
        by_word[first] = [self.packed.get((lang, words[i]), -1) for i in first.tolist()]
        dealt = first[by_word[first] < 0]
        by_word[dealt] = [xxhash.xxh3_64_intdigest(lang.encode() + b" " + words[i]) % self.groups for i in dealt.tolist()]
        group = by_word[rows[:, 0]]
        if self.heavy:
            split = np.array([(lang, w) in self.heavy for w in words])
            at = np.flatnonzero(split[rows[:, 0]])
            own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            own[0] = 0
            more = np.array([(lang, words[a], words[b]) in self.heavy_pairs for a, b in rows[at, :2].tolist()], bool) if self.heavy_pairs else np.zeros(len(at), bool)
            mixed = own[rows[at, 0]] * _ODD[0] + own[rows[at, 1]] * _ODD[1]
            for k in range(2, rows.shape[1]):
                mixed += np.where(more, own[rows[at, k]] * _ODD[k], np.uint64(0))
            group[at] = (mixed >> np.uint64(20)) % np.uint64(self.groups)
        return group


def partition(docs: DataFrame, counts: DataFrame, budget: int = BUDGET, flush: int = FLUSH) -> Partition:
    """The vertical partition for kept `word_counts`.

    The driver sees words with over a sixteenth of a group's suffixes (so at most 16 times GROUPS of them), and pairs with
    more than a group's (at most GROUPS): with more words than GROUPS budgets hold, the budget grows.
    """
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(budget, -(-n // GROUPS))
    large = [tuple(r) for r in counts.where(F.col("n") > budget // 16).select("lang", "word", "n").collect()]
    found = Partition(n, large, budget)
    if found.heavy:
        pairs = _pair_counts(docs, found.heavy, flush).where(F.col("n") > budget).collect()
        found.heavy_pairs = {(r["lang"], r["first"].encode(), r["word"].encode()) for r in pairs}
    return found


def suffixes(docs: DataFrame, by: Partition, depth: int = DEPTH, flush: int = FLUSH) -> DataFrame:
    """Packed rows of distinct suffixes with their counts: one for each group and stretch of texts that a task has read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, numbers in _by_lang(batches, flush):
            padded = np.concatenate([numbers, np.zeros(depth, np.int32)])
            rows = np.stack([padded[k : k + len(numbers)] for k in range(depth)], axis=1)
            rows = rows[rows[:, 0] > 0]
            for k in range(1, depth):
                rows[rows[:, k - 1] == 0, k] = 0
            if not len(rows):
                continue
            rows, counts = _distinct(rows, np.ones(len(rows), np.int64), len(words))
            group = by.group_of(lang, words, rows)
            order = np.argsort(group, kind="stable")
            rows, counts, group = rows[order], counts[order], group[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
                used, own = np.unique(np.append(rows[lo:hi].ravel(), 0), return_inverse=True)
                own = own[:-1].reshape(-1, depth)
                kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
                columns = np.ascontiguousarray(own.T.astype(kind))  # by column: the first ones are sorted and shrink well
                yield pd.DataFrame({"group": [int(group[lo])], "lang": [lang], "words": [[words[i] for i in used[1:].tolist()]], "suffixes": [columns.tobytes()], "counts": [counts[lo:hi].astype(np.uint32).tobytes()]})

    return _texts(docs).mapInPandas(run, SUFFIXES)


def _distinct(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, with the sums of their counts."""
    bits = max(1, int(size).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for at in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), np.int64)
        for k in range(at, min(at + each, rows.shape[1])):
            key = key << bits | rows[:, k]
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(counts, first)


def _subtree(by: Partition, least: int):
    """Nodes of a group's subtree with at least `least` occurrences, or any number where other groups have some too."""

    def run(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
        lang = key[1]
        numbers, rows, counts = _Numbers(), [], []
        for words, data, n in zip(packed["words"], packed["suffixes"], packed["counts"], strict=True):
            own = np.array([0, *map(numbers.__getitem__, map(bytes, words))], np.int64)
            n = np.frombuffer(n, np.uint32)
            kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
            rows.append(own[np.frombuffer(data, kind).reshape(-1, len(n))].T)
            counts.append(n.astype(np.int64))
        rows, counts = _distinct(np.concatenate(rows), np.concatenate(counts), len(numbers))
        words = ["" if w == _BREAK else w.decode() for w in numbers]
        heavy = np.array([(lang, w) in by.heavy for w in numbers])
        pairs = by.heavy_pairs if heavy.any() else ()
        new, out = np.zeros(len(rows), bool), []
        new[:1] = True
        for k in range(rows.shape[1]):
            new[1:] |= rows[1:, k] != rows[:-1, k]
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            nodes = rows[first]
            whole = nodes[:, k] > 0
            split = heavy[nodes[:, 0]] if k == 0 else np.zeros(len(nodes), bool)
            if pairs and k in (1, 2):
                split = np.array([heavy[a] and (lang, words[a].encode(), words[b].encode()) in pairs for a, b in nodes[:, :2].tolist()])
            for at in np.flatnonzero(whole & (split | (total >= least))).tolist():
                out.append((lang, " ".join(words[i] for i in nodes[at, : k + 1].tolist()), k + 1, int(total[at])))
        return pd.DataFrame(out, columns=["lang", "phrase", "size", "n"])

    return run


def phrase_counts(docs: DataFrame, by: Partition, least: int = LEAST, depth: int = DEPTH, flush: int = FLUSH) -> DataFrame:
    """(lang, phrase, size, n) of all phrases of up to `depth` words that occur `least` times or more."""
    nodes = suffixes(docs, by, depth, flush).groupBy("group", "lang").applyInPandas(_subtree(by, least), "lang string, phrase string, size int, n long")
    # only the nodes above a split prefix have parts in several groups
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the candidates among kept `phrase_counts`: the lowest-scoring cut of each."""
    words = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("size") - k).alias("tail")))
    rows = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    for side, n in (("head", "l"), ("tail", "r")):
        rows = rows.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div cast(l + r as decimal(20,0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def kept_phrases(candidates: DataFrame) -> DataFrame:
    """Candidates without those whose words lie within a longer one that has four fifths of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where("longer is null or 5 * longer < 4 * a").drop("longer")


def best_of_each(rows: DataFrame, top: int, shares: int = 64) -> DataFrame:
    """The first `top` of each lang with their rank; first of hashed shares of each, so that no task sorts all of a lang."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, budget: int = BUDGET, flush: int = FLUSH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    Texts have A-Z in lower case, are split into pieces at `.,;:!?` and line ends, and pieces into words at spaces and tabs.
    Phrases have 2 to `depth` words within a piece and occur `least` times or more, overlaps included; n are all words of the
    language. Of all ways to cut a phrase in two with l and r occurrences the lowest score, floor(2000000 a / (l + r)), counts,
    the first of equal ones. Null texts are empty, a null lang is `und`; long texts are read whole, repeated rows each count,
    rows without words give none, and an empty table gives no row. Columns besides lang and text are not read.
    """
    words = keep(word_counts(docs, flush))
    counts = keep(phrase_counts(docs, partition(docs, words, budget, flush), least, depth, flush))
    best = best_of_each(kept_phrases(keep(scored(counts))), top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents; odd rows as `collocations` says."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, {DEPTH + 1}) s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, sum(n)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY 1),
often AS (SELECT * FROM grams WHERE n >= {LEAST}),
cuts AS (
  SELECT lang, phrase, size, n AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1)),
rated AS (SELECT c.*, h.n AS l, t.n AS r, (2000000::HUGEINT * a // (h.n + t.n))::BIGINT AS score FROM cuts c JOIN often h ON c.lang = h.lang AND head = h.phrase JOIN often t ON c.lang = t.lang AND tail = t.phrase),
candidates AS (SELECT lang, phrase, size, a, l, r, score FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w FROM candidates WHERE size > 2), range(2, {DEPTH}) s(m), range(1, {DEPTH}) t(i) WHERE m < size AND i + m - 1 <= size),
most AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
left_ AS (SELECT c.* FROM candidates c LEFT JOIN most m ON c.lang = m.lang AND c.phrase = m.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, s.n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_) JOIN sizes s USING (lang) WHERE rank <= {TOP}
"""
