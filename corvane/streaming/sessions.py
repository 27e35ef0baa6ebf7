"""Prompts as a stream: the gate with each session's last prompt, and the highest form of a card that a session has had."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import gate, queue

RETENTION_MS = 7 * 86_400_000
LEVEL = "session_id string, card_id string, seq long, level int, sent boolean"
#: New bytes, and milliseconds since the last reading, from which a transcript is read before its session ends.
NEW_BYTES, WAIT_MS = 16 << 10, 600_000


def with_last_prompt(prompts: DataFrame) -> DataFrame:
    """(session_id, ts, prompt, last_prompt) of a stream (session_id, ts, prompt, source).

    A session's state is its last prompt, which goes after seven days, and on a row whose source is `compact`. The gate
    itself is an expression on the result, so Python only carries prompts forward.
    """

    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "prompt"], ignore_index=True)
        out = []
        for r in rows.itertuples():
            if r.source == "compact":
                last = ""
                continue
            out.append((key[0], r.ts, r.prompt, last))
            last = r.prompt[: gate.KEPT_PROMPT]
        state.update((last,))
        state.setTimeoutDuration(RETENTION_MS)
        yield pd.DataFrame(out, columns=["session_id", "ts", "prompt", "last_prompt"])

    schema = "session_id string, ts long, prompt string, last_prompt string"
    return prompts.groupBy("session_id").applyInPandasWithState(carry, schema, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gated(prompts: DataFrame) -> DataFrame:
    rows = with_last_prompt(prompts)
    return rows.withColumn("reason", gate.gate(F.col("prompt"), F.col("last_prompt")))


class _Rising(StatefulProcessor):
    """The highest form of each card that a session has had, kept for seven days since it was last raised."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "card_id string", "level int", RETENTION_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "card_id", "level"], ignore_index=True)
        best, out = {}, []
        for seq, card, level in zip(batch["seq"].tolist(), batch["card_id"].tolist(), batch["level"].tolist(), strict=True):
            if card not in best:
                had = self.best.getValue((card,)) if self.best.containsKey((card,)) else None
                best[card] = had[0] if had else 0
            sent = level > best[card]
            if sent:
                best[card] = level
                self.best.updateValue((card,), (level,))
            out.append((key[0], card, seq, level, sent))
        yield pd.DataFrame(out, columns=["session_id", "card_id", "seq", "level", "sent"])

    def close(self) -> None:
        pass


def upgrades(deliveries: DataFrame) -> DataFrame:
    """(session_id, card_id, seq, level, sent) of a stream (session_id, card_id, seq, level): only a higher form than before is sent.

    Each row is judged by itself in the order of `seq` within its session, so the output is the same however the rows fall
    into batches. State is one entry for each card of a session. Needs the RocksDB state store.
    """
    return deliveries.groupBy("session_id").transformWithStateInPandas(_Rising(), LEVEL, "append", "ProcessingTime")


class _Flushing(StatefulProcessor):
    """What of a transcript is read, when, and how far it has grown; a timer for what must wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "offset long, at long, size long, seen long")

    def _due(self, offset: int, at: int, size: int) -> int | None:
        """When enough new bytes may be read, if there are enough; a transcript never read waits for none."""
        return None if size - offset < NEW_BYTES else 0 if at < 0 else at + WAIT_MS

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        batch["ms"] = batch["ts"].astype("datetime64[ms]").astype("int64")
        batch = batch.sort_values(["ms", "size"], ignore_index=True)
        offset, at, size, seen = self.read.get() if self.read.exists() else (0, -1, 0, 0)
        out = []
        for ms, now, final in zip(batch["ms"].tolist(), batch["size"].tolist(), (batch["trigger"] == "session-end").tolist(), strict=True):
            due = self._due(offset, at, size)
            if due is not None and due <= ms and seen:  # it waited, and its time came before this row
                out.append((key[0], key[1], size, max(due, seen), "stop"))
                offset, at = size, max(due, seen)
            size, seen = now, ms
            if now < offset:  # replaced: read from its start
                offset = 0
            due = self._due(offset, at, size)
            if size > offset and (final or (due is not None and due <= ms)):
                out.append((key[0], key[1], size, ms, "session-end" if final else "stop"))
                offset, at = size, ms
        self._keep(offset, at, size, seen)
        yield _jobs(out)

    def _keep(self, offset: int, at: int, size: int, seen: int) -> None:
        self.read.update((offset, at, size, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self._due(offset, at, size)
        if due is not None:
            self.handle.registerTimer(max(due, 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.read.exists():
            offset, at, size, seen = self.read.get()
            due = self._due(offset, at, size)
            if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], key[1], size, max(due, seen), "stop"))
                self.read.update((size, max(due, seen), size, seen))
        yield _jobs(out)

    def close(self) -> None:
        pass


def _jobs(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session_id", "transcript_path", "size", "ms", "trigger"])
    return out.astype({"size": "int64", "ms": "int64"})


def flushes(stops: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(job, session_id, transcript_path, size, at, trigger) of a stream (session_id, transcript_path, ts, size, trigger).

    A transcript is to be read when its session ends (`session-end`) and it has grown, and otherwise when it has 16 KiB of
    new bytes and ten minutes have passed since it was last read. What has the bytes but must wait is given by a timer of
    event time, so a session that goes quiet loses nothing. `job` is stable: the queue replaces a job of its name. Needs the
    RocksDB state store.
    """
    timed = stops.where("transcript_path is not null and transcript_path != ''").withWatermark("ts", delay)
    jobs = timed.groupBy("session_id", "transcript_path").transformWithStateInPandas(_Flushing(), "session_id string, transcript_path string, size long, ms long, trigger string", "append", "EventTime")
    return jobs.select(queue.job_key(F.lit(""), F.col("session_id"), F.col("transcript_path")).alias("job"), "session_id", "transcript_path", "size", F.timestamp_millis("ms").alias("at"), "trigger")


def settled_once(ends: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first end of each session within the watermark."""
    return ends.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id"])


def delivery_counts(injections: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Deliveries by event and hour, late rows up to `delay`; an extension for live reports."""
    return injections.withWatermark("ts", delay).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
