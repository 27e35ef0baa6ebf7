"""Session transcripts in two JSONL shapes, as ordered entries (session_id, idx, role, text, tool_errors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,is_error:boolean,content:string>>"
MESSAGE = "struct<type:string,isSidechain:boolean,message:struct<role:string,content:string>>"
ITEM = "struct<type:string,payload:struct<type:string,role:string,content:string,output:string,success:boolean>>"
#: Turns that a tool wraps around a session, not what a user said.
ENVELOPE = r"^\s*<(?:environment_context|user_instructions|permissions|turn_aborted)"


def _texts(content: Column, kinds: tuple[str, ...]) -> Column:
    """The text of a message whose content is a string, or a list of parts."""
    parts = F.filter(F.from_json(content, PART), lambda p: p["type"].isin(*kinds) & p["text"].isNotNull())
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(F.coalesce(content, F.lit("")))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("line_no")
    return rows.where("text != '' or size(tool_errors) > 0").select("session_id", (F.row_number().over(order) - 1).alias("idx"), "role", "text", "tool_errors")


def _said(rows: DataFrame) -> DataFrame:
    return rows.where("text != '' or size(tool_errors) > 0").select("session_id", "line_no", "role", "text", "tool_errors")


def message_lines(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, role, text, tool_errors) of lines with a `message`: what `message_entries` numbers, for streams too."""
    return _said(_messages(lines))


def message_entries(lines: DataFrame) -> DataFrame:
    """Entries of (session_id, line_no, value) lines with a `message`; unknown lines and side chains are skipped."""
    return _numbered(_messages(lines))


def _messages(lines: DataFrame) -> DataFrame:
    rows = lines.select("session_id", "line_no", F.from_json("value", MESSAGE).alias("x")).where("x.type in ('user', 'assistant') and not coalesce(x.isSidechain, false)")
    content = F.col("x.message.content")
    results = F.filter(F.from_json(content, PART), lambda p: (p["type"] == "tool_result") & F.coalesce(p["is_error"], F.lit(False)))
    errors = F.when(content.startswith("["), F.transform(results, lambda p: _texts(p["content"], ("text",)))).otherwise(F.array().cast("array<string>"))
    return rows.select("session_id", "line_no", F.coalesce("x.message.role", "x.type").alias("role"), _texts(content, ("text",)).alias("text"), F.coalesce(errors, F.array().cast("array<string>")).alias("tool_errors"))


def rollout_entries(lines: DataFrame) -> DataFrame:
    """Entries of (session_id, line_no, value) lines that are response items; explicit tool failures are errors."""
    rows = lines.select("session_id", "line_no", F.from_json("value", ITEM).alias("x")).where("x.type = 'response_item'")
    kind, said = F.col("x.payload.type"), _texts(F.col("x.payload.content"), ("input_text", "output_text", "text"))
    message = (kind == "message") & F.col("x.payload.role").isin("user", "assistant") & ~said.rlike(ENVELOPE)
    failed = (kind == "function_call_output") & ~F.coalesce("x.payload.success", F.lit(True))
    text = F.when(message, said).otherwise("")
    errors = F.when(failed, F.array(F.coalesce("x.payload.output", F.lit("")))).otherwise(F.array().cast("array<string>"))
    return _numbered(rows.where(message | failed).select("session_id", "line_no", F.coalesce("x.payload.role", F.lit("assistant")).alias("role"), text.alias("text"), errors.alias("tool_errors")))


def grown_entries(lines: DataFrame, suffix: str = ".jsonl") -> DataFrame:
    """(session_id, line_no, role, text, tool_errors) of `incremental.growing_lines`: a session is a file's name, a line's number its offset."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = lines.select(F.left(name, F.char_length(name) - len(suffix)).alias("session_id"), F.col("offset").alias("line_no"), "value")
    return message_lines(rows)
