"""Sum-of-squares packing of tokenised documents into sequences.

A document's ids are cut into full sequences and a rest. Rests are packed online: each goes to the fill level that
minimises the squared counts of partly filled sequences, summed over the levels, which an array of levels tracks
(Csirik et al., "On the sum-of-squares algorithm for bin packing", 2006).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep

LENGTH, END = 2048, 1
#: Pieces packed by one task; a shard leaves some sequences partly filled.
SHARD = 60_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: How the byte-level vocabulary splits texts; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile(r"[^\x00-\u024f\u2010-\u203a]|\s{5000}").search


class Encoder:
    """Ids of texts by a byte-level vocabulary file of `tokenizers`.

    Texts in Latin letters go to tiktoken with the same vocabulary, which gives the same ids three times as fast; those
    with other letters, with the string of a special token, or with a run of 5,000 white spaces or more, which its
    pattern would recurse on, go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the vocabulary file writes bytes that aren't visible characters as characters from 256 on, in order
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in self.special}
        self.fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _OTHER(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of each row of `docs`: full sequences, then the rest; null text is empty and has the end id alone.

    A text of any length is encoded whole. A null doc_id stays null; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            out = []
            for doc_id, text in zip(batch["doc_id"], texts, strict=True):
                ids = array("I", [*encoder.encode(text), END])
                n = len(ids)
                out += [(doc_id, at, min(length, n - at), zlib.crc32(ids[at : at + length]), n) for at in range(0, n, length)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def sum_of_squares(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in order."""
    levels = np.zeros(length + 1, np.int64)  # sequences filled to each level; empty and full ones don't count
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        room = length - s + 1
        # what each choice adds to the sum of squares, less one: -2 N[f] + 1 for the level left, 2 N[f + s] + 1 for the one reached
        cost = 2 * (levels[s:] - levels[:room])
        cost[0] -= 1  # a new sequence leaves no level
        cost[-1] -= 1  # a full one reaches none
        cost[1:][levels[1:room] == 0] = np.iinfo(np.int64).max
        level = room - 1 - int(cost[::-1].argmin())  # among equals the fullest
        if level:
            levels[level] -= 1
            at = open_[level].pop()
        else:
            at, made = made, made + 1
        sequence[i], offset[i] = at, level
        if level + s < length:
            levels[level + s] += 1
            open_[level + s].append(at)
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Pieces of all rows of `docs`, with sequence_id and offset.

    Pieces are dealt evenly to shards of about `shard` pieces, which are packed apart; so one key can't fill a task.
    Repeated rows give pieces of their own. An empty table gives no piece.
    """
    cut = keep(pieces(docs, tokenizer_path, length))
    shards = max(1, -(-cut.count() // shard))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at"], ignore_index=True)
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(rows["shard"].to_numpy().astype(np.int64) << 40) + sequence, offset=offset).drop(columns=["shard", "at"])

    # rows of a kept table: their numbers don't change when a task is run again
    dealt = cut.withColumn("at", F.xxhash64(F.monotonically_increasing_id(), "doc_id", "start")).withColumn("shard", F.pmod("at", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
