"""The prompt gate: which prompts need no retrieval, and what text of the others is the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

# Acknowledgements, matched against a whole prompt once both are folded.
ACKS = (
    "yes", "y", "no", "ok", "okay", "k", "kk", "continue", "go ahead", "do it", "sounds good", "thanks", "thank you", "lgtm", "proceed",
    "sure", "yep", "yeah", "nope", "nice", "good", "great", "done", "next", "go on", "keep going", "looks good", "approved", "ship it",
    "u", "o", "um", "da", "vang", "duoc", "ok do", "lam di", "tiep tuc", "tiep di", "tiep", "dung roi", "duoc do", "cam on", "tot", "dong y",
    "lam luon", "ok luon", "chuan", "chuan roi",
)
SHORT, PASTE, HEAD, TAIL, SAME_TOPIC, KEPT_PROMPT = 12, 4000, 800, 400, 0.6, 4096
# Fixed value: how lines of logs and stack traces begin.
_LOG_LINE = r"^(?:[\s]*(?:at |Error|panic:|goroutine |0x|#|File \"|Traceback|[0-9]{4}.|\[[0-9]{2}..)|\t|    )"


def edges(s: Column) -> Column:
    """Head and tail of a long text, in characters."""
    return F.when(F.char_length(s) > HEAD + TAIL, F.concat(F.substring(s, 1, HEAD), F.lit("\n…\n"), F.right(s, F.lit(TAIL)))).otherwise(s)


def log_shaped(s: Column) -> Column:
    """Five lines or more, of which over 60 % look like a log or a stack trace."""
    lines = F.split(s, "\n")
    shaped = F.size(F.filter(lines, lambda x: x.rlike(_LOG_LINE) & (F.trim(x) != "")))
    return (F.size(lines) >= 5) & (shaped * 10 > F.size(lines) * 6)


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\u0085 ]+|[\s\u0085 ]+$", "")


def gate(prompt: Column, last: Column, acks: tuple[str, ...] = (), stop_words: tuple[str, ...] = ()) -> Column:
    """Why a prompt is skipped: slash, ack, short, paste or novelty; null if it isn't. `acks` and `stop_words` extend the fixed ones."""
    s, stops = stripped(prompt), (*t.STOP_WORDS, *t.folded(stop_words))
    ack = t.fold(F.regexp_replace(s, r"^[.!?,;:]+|[.!?,;:]+$", "")).isin(*ACKS, *t.folded(acks))
    long_ = F.octet_length(s) > PASTE
    query = F.when(long_, edges(s)).otherwise(s)
    same = (last != "") & (t.jaccard(t.terms(query, 0, stops), t.terms(last, 0, stops)) > SAME_TOPIC)
    return (
        F.when(s.startswith("/"), "slash").when(ack, "ack").when(F.octet_length(s) < SHORT, "short")
        .when(long_ & log_shaped(s) & ~edges(s).contains("?"), "paste").when(same, "novelty")
    )


def gated(prompts: DataFrame, acks: tuple[str, ...] = (), stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, ts, prompt) with `reason` and `query`; the last prompt counts even if it was skipped itself."""
    order = Window.partitionBy("session_id").orderBy("ts", "prompt")
    rows = prompts.withColumn("last_prompt", F.coalesce(F.lag(F.substring("prompt", 1, KEPT_PROMPT)).over(order), F.lit("")))
    rows = rows.withColumn("reason", gate(F.col("prompt"), F.col("last_prompt"), acks, stop_words))
    s = stripped(F.col("prompt"))
    return rows.withColumn("query", F.when(F.col("reason").isNull(), F.when(F.octet_length(s) > PASTE, edges(s)).otherwise(s)))
