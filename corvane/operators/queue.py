"""The queue of transcripts to read, as events folded by a stable key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as t

#: Failures after which a job is parked.
ATTEMPTS = 3
DEFAULT_SOURCE = "claude"


def job_key(source: Column, session: Column, path: Column) -> Column:
    """The stable name of a job: one for each source, session and transcript, so that queueing it again replaces it."""
    source = F.when(F.coalesce(source, F.lit("")) == "", DEFAULT_SOURCE).otherwise(source)
    return t.short_hash(F.concat(source, F.coalesce(session, F.lit("")), path), 16)


def job_states(events: DataFrame) -> DataFrame:
    """(job, state, attempts, enqueued_at, trigger) of each job from its events.

    events: seq (their order), ts, kind (`enqueue`, `fail` or `done`), source, session_id, transcript_path, trigger. An event
    without a transcript is none. What came before the last `enqueue` of a job counts nothing; then `done` removes it, and
    the third failure parks it: so the state is `done`, `parked` or `queued`. Events of a job that was never queued are left out.
    All are sums of a key that are combined before the shuffle, so a job of very many events gathers nowhere.
    """
    rows = events.where("transcript_path is not null and transcript_path != ''").withColumn("job", job_key(F.col("source"), F.col("session_id"), F.col("transcript_path")))
    begun = rows.where("kind = 'enqueue'").groupBy("job").agg(F.max_by(F.struct("seq", "ts", "trigger"), "seq").alias("b"))
    begun = begun.select("job", F.col("b.seq").alias("since"), F.col("b.ts").alias("enqueued_at"), "b.trigger")
    later = rows.where("kind != 'enqueue'").select("job", "seq", "kind").join(begun.select("job", "since"), "job").where("seq > since")
    # a failure behind the end of a job is none of its own
    ends = later.groupBy("job").agg(F.min(F.when(F.col("kind") == "done", F.col("seq"))).alias("end"))
    fails = later.join(ends, "job").groupBy("job").agg(F.count_if((F.col("kind") == "fail") & (F.col("end").isNull() | (F.col("seq") < F.col("end")))).alias("fails"), F.first("end").alias("end"))
    out = begun.join(fails, "job", "left")
    attempts = F.least(F.coalesce("fails", F.lit(0)), F.lit(ATTEMPTS))
    state = F.when(attempts >= ATTEMPTS, "parked").when(F.col("end").isNotNull(), "done").otherwise("queued")
    return out.select("job", state.alias("state"), attempts.cast("int").alias("attempts"), "enqueued_at", "trigger")


def next_jobs(states: DataFrame, most: int) -> DataFrame:
    """The `most` newest jobs that wait, ties by name; all with a negative number."""
    waiting = states.where("state = 'queued'").orderBy(F.desc("enqueued_at"), "job")
    return waiting if most < 0 else waiting.limit(most)
