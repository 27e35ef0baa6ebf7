"""Signal windows in transcripts: triggers, merged intervals, the cap, and what the windows hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions.storage import written

BEFORE, AFTER, MOST, REPEAT_TERMS, REPEAT_GAP, REPEAT = 2, 2, 12, 5, 3, 0.6
#: Terms of sets that meet in a task, on average, and turns that a row of equal ones spans.
TASK_TERMS, TURNS = 1 << 20, 1 << 16
# Phrases of a correction (anywhere, at the start), and marks of a rejected tool.
PHRASES = (
    "dont", "do not", "not what", "wrong", "instead", "actually", "i already", "i said", "i told you", "undo", "revert", "stop",
    "khong phai", "khong dung", "sai roi", "dung lai", "da bao", "da noi", "lam lai",
)
STARTS = ("no", "khong", "sai", "wait")
REJECTED = ("doesn't want to proceed", "user said", "interrupted by user")
#: Labels by the priority that decides which one a merged window gets.
PRIORITY = {"rejection": 3, "correction": 2, "repeated": 1, "tool_error": 0}


def is_correction(s: Column) -> Column:
    norm = t.plain_phrases(s)
    return norm.rlike(rf"^(?:{'|'.join(STARTS)})(?: |$)|(?:^| )(?:{'|'.join(PHRASES)})(?: |$)")


def is_rejection(tool_errors: Column) -> Column:
    return F.exists(tool_errors, lambda e: t.fold(e).rlike("|".join(REJECTED)))


def _again() -> Callable[[pa.Table], pa.Table]:
    """The turns of a table of sets whose first like one, of the same session, is far enough back.

    Terms in common are counted for one set at a time, by the earlier sets of its session that hold them.
    """

    def again(sets: pa.Table) -> pa.Table:
        sets = sets.append_column("s", sets["session_id"].combine_chunks().dictionary_encode().indices)
        sets = sets.take(pc.sort_indices(sets, [("s", "ascending"), ("first", "ascending")]))
        s, first = sets["s"].to_numpy().astype(np.int64), sets["first"].to_numpy().astype(np.int64)
        words = pc.split_pattern(sets["terms"].combine_chunks(), " ")
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        word, row = words.flatten().dictionary_encode(), np.repeat(np.arange(len(n)), n)
        _, term = np.unique(s[row] * len(word.dictionary) + word.indices.to_numpy(), return_inverse=True)
        holders = row[np.argsort(term, kind="stable")]
        start = np.r_[0, np.cumsum(np.bincount(term))]
        # where a set stands among the holders of each of its terms: those before are of its session, and earlier
        at = np.empty(len(row), np.int64)
        at[np.argsort(term, kind="stable")] = np.arange(len(row))
        begin, end, ends = start[term].tolist(), at.tolist(), np.r_[0, np.cumsum(n)].tolist()
        opens = np.searchsorted(s, s).tolist()
        earliest = first.copy()
        for i in range(len(n)):
            lo = opens[i]
            found = [holders[begin[k] : end[k]] for k in range(ends[i], ends[i + 1]) if begin[k] < end[k]]
            if found:
                both = np.bincount(np.concatenate(found) - lo, minlength=i - lo)
                alike = both / (n[lo:i] + n[i] - both) >= REPEAT
                if alike.any():
                    earliest[i] = first[lo + int(alike.argmax())]
        turns = sets["turns"].combine_chunks()
        size = pc.list_value_length(turns).to_numpy(zero_copy_only=False)
        row, idx = np.repeat(np.arange(len(n)), size), turns.flatten().to_numpy()
        far = earliest[row] < idx - REPEAT_GAP
        return pa.table({"session_id": sets["session_id"].take(row[far]), "idx": idx[far]})

    return again


def repeats(entries: DataFrame) -> DataFrame:
    """(session_id, idx) of user turns whose terms are mostly those of an earlier one, over three turns back.

    Equal turns of a session are one set, known by the first of them (a row for each `TURNS` places, so no row grows without
    bound). Sessions are dealt to tasks by their number of terms, and the sets of a larger session to parts, each two of which
    meet in a task. So sets are shuffled, pairs never; a turn is a repeat if the first of all sets like its own is far enough back.
    """
    said = entries.where("role = 'user' and session_id is not null").select("session_id", "idx", F.array_sort(t.terms(F.col("text"))).alias("terms")).where(F.size("terms") >= REPEAT_TERMS)
    said = said.select("session_id", "idx", F.array_join("terms", " ").alias("terms"), F.size("terms").alias("n"))
    sets = written(said.groupBy("session_id", "terms", "n", F.floor(F.col("idx") / TURNS)).agg(F.min("idx").alias("first"), F.collect_list("idx").alias("turns")).select("session_id", "terms", "n", "first", "turns"))
    sizes = sets.groupBy("session_id").agg(F.sum("n").alias("size")).withColumn("parts", F.ceil(F.col("size") / TASK_TERMS).cast("int"))
    buckets = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // TASK_TERMS))
    large = written(sizes.where("parts > 1").select(F.col("session_id").alias("large"), "parts"))
    rows = sets.join(large, F.col("session_id") == F.col("large"), "left").withColumn("part", F.pmod(F.xxhash64("terms"), F.col("parts")).cast("int"))
    # a part meets each other one, and itself along with them
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
    meets = F.transform(F.coalesce(others, F.array(F.lit(0))), lambda k: F.struct(F.least(k, "part").alias("a"), F.greatest(k, "part").alias("b")))
    rows = rows.select("session_id", "terms", "first", "turns", "large", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"), F.explode(meets).alias("meets"))

    kinds = dict(entries.dtypes)
    found = rows.groupBy("bucket", "large", "meets").applyInArrow(_again(), f"session_id {kinds['session_id']}, idx {kinds['idx']}")
    return found.distinct()


def triggers(entries: DataFrame) -> DataFrame:
    """(session_id, idx, reason, start, end): a window around each trigger."""
    span = F.count("*").over(Window.partitionBy("session_id"))
    rows = entries.withColumn("n", span).join(repeats(entries).withColumn("again", F.lit(True)), ["session_id", "idx"], "left")
    reason = (
        F.when((F.col("role") == "user") & is_correction(F.col("text")), "correction").when(is_rejection(F.col("tool_errors")), "rejection")
        .when(F.col("again"), "repeated").when(F.size("tool_errors") > 0, "tool_error")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("session_id", "idx", "reason", F.greatest(F.lit(0), F.col("idx") - BEFORE).alias("start"), F.least(F.col("n") - 1, F.col("idx") + AFTER).alias("end"))


def priority(reason: Column) -> Column:
    return F.get(F.map_values(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))), F.array_position(F.array(*map(F.lit, PRIORITY)), reason).cast("int") - 1)


def merged(windows: DataFrame, key: str = "session_id") -> DataFrame:
    """Windows that overlap or touch as one, with the reason of the highest priority."""
    order = Window.partitionBy(key).orderBy("start", "end", "reason")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = windows.withColumn("new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.max_by("reason", F.struct(priority(F.col("reason")), -F.col("start")))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), label.alias("reason")).drop("island")


def capped(windows: DataFrame, most: int = MOST) -> DataFrame:
    """At most twelve windows of a session: the earliest of the lowest priority go first."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(priority(F.col("reason"))), F.desc("start")))
    return windows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def window_entries(windows: DataFrame, entries: DataFrame) -> DataFrame:
    """The turns of each window, by an equi-join on the turns it spans."""
    spread = windows.withColumn("idx", F.explode(F.sequence("start", "end")))
    return spread.join(entries, ["session_id", "idx"])


def without_own(entries: DataFrame, sentinel: str) -> DataFrame:
    """Sessions that hold no user turn that starts with the sentinel of a run of our own."""
    own = entries.where((F.col("role") == "user") & F.ltrim("text").startswith(sentinel)).select("session_id").distinct()
    return entries.join(own, "session_id", "left_anti")


def byte_capped(sections: DataFrame, key: str, order: str, most: int, marker: str) -> DataFrame:
    """(key, text): the `section` texts of each key in order, up to the first that would pass `most` bytes; then the marker.

    Later sections aren't tried, even if they'd fit. What is gathered of a key is at most `most` bytes and its number of
    sections; sizes are summed up in a window without the texts of sections that are over.
    """
    reach = F.sum(F.octet_length("section")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = sections.select(key, order, "section", reach.alias("reach")).select(key, order, F.when(F.col("reach") <= most, F.col("section")).alias("section"))
    kept = F.collect_list(F.when(F.col("section").isNotNull(), F.struct(order, "section")))
    out = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(kept), lambda x: x["section"]), "").alias("text"), F.bool_or(F.col("section").isNull()).alias("over"))
    return out.select(key, F.when(F.col("over"), F.concat("text", F.lit(marker))).otherwise(F.col("text")).alias("text"))


# How windows are written for a reader, and the bytes of a turn and of a tool error that are shown.
WINDOW_HEAD, FURTHER_WINDOWS, ENTRY_BYTES, ERROR_BYTES = "--- window %d (%s) ---\n", "--- (further windows truncated) ---\n", 600, 300


def rendered(windows: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """(session_id, text): the windows of each session in order, with their turns and tool errors cut, in at most `most` bytes."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("start"))
    rows = window_entries(windows.select("session_id", "start", "end", "reason", nth.alias("nth")), entries)
    errors = F.array_join(F.transform("tool_errors", lambda e: F.concat(F.lit("tool_error: "), t.truncated(e, ERROR_BYTES), F.lit("\n"))), "")
    said = F.when(F.col("text") != "", F.concat("role", F.lit(": "), t.truncated(F.col("text"), ENTRY_BYTES), F.lit("\n"))).otherwise("")
    turns = rows.select("session_id", "nth", "reason", "idx", F.concat(said, errors).alias("turn")).groupBy("session_id", "nth", "reason").agg(F.sort_array(F.collect_list(F.struct("idx", "turn"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda x: x["turn"]), "")
    return byte_capped(turns.select("session_id", "nth", F.concat(F.format_string(WINDOW_HEAD, "nth", "reason"), body).alias("section")), "session_id", "nth", most, FURTHER_WINDOWS)
