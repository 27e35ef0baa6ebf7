"""Chat formatting with a grammar round trip, with DataFrame functions only.

A conversation is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. A deterministic parser reads rendered turns back;
a turn that it doesn't read back as it was has its text, or role, escaped, after which the parser returns it unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Escapes, in the order in which they are written; reading undoes them in the opposite order.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))


def escape(text: Column, newlines: bool = False) -> Column:
    """No control string is left, as each holds a <; newlines are escaped in roles alone."""
    for plain, code in ESCAPES if newlines else ESCAPES[:2]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation: what stands before the first start is no turn."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def turn(part: Column) -> Column:
        body = F.split(part, r"<\|im_end\|>\n", 2)[0]
        return F.struct(unescape(F.substring_index(body, "\n", 1)).alias("role"), unescape(F.regexp_replace(body, r"\A[^\n]*+\n?", "")).alias("text"))

    return F.transform(parts, turn)


def formatted_turns(rows: DataFrame) -> DataFrame:
    """`rows` with `piece`, each turn rendered; its text and role are escaped only if they don't survive the round trip."""
    rows = rows.withColumns({"_role": F.coalesce("role", F.lit("")), "_text": F.coalesce("text", F.lit(""))})
    source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    tries = [render(F.col("_role"), F.col("_text")), render(F.col("_role"), escape(F.col("_text"))), render(escape(F.col("_role"), True), escape(F.col("_text")))]
    rows = rows.withColumn("piece", tries[0])
    for again in tries[1:]:
        # a piece must also hold each control string once, or other parsers might read it otherwise
        once = [F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(m), F.lit(""))) == len(m) for m in (START, END.strip())]
        whole = (parse(F.col("piece")) == source) & once[0] & once[1]
        rows = rows.withColumn("piece", F.when(whole, F.col("piece")).otherwise(again))
    return rows.drop("_role", "_text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the rendered conversation, and its turns as the parser reads them back from it.

    Turns go by `turn`, then role and text where that ties; null turns come first, null texts and roles are empty, and
    null conv_ids are one conversation. A conversation is one text, so its turns meet in one row.
    """
    pieces = formatted_turns(conversations).select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "piece").alias("x"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = whole.select("conv_id", F.array_join(F.col("x")["piece"], "").alias("formatted"))
    return whole.withColumn("turns", parse(F.col("formatted")))


def with_loss(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds `loss`, the texts that bear a loss, as the parser reads them."""
    return formatted.withColumn("loss", F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"]))


def loss_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds `loss_spans`, the places (start, end) in `formatted` of what bears a loss: code points, end exclusive.

    They hold texts as they are written, escapes included. A conversation without such a turn has none. Places are summed
    up turn by turn, so a conversation of very many turns costs the square of their number.
    """
    parts = F.transform(F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x, i: i > 0), lambda x: F.struct(F.substring_index(x, "\n", 1).alias("head"), F.length(x).alias("chars"), F.length(F.split(x, r"<\|im_end\|>\n", 2)[0]).alias("body")))

    def step(acc, x):
        start = acc["at"] + len(START) + F.length(x["head"]) + 1
        span = F.struct(start.alias("start"), (acc["at"] + len(START) + x["body"]).alias("end"))
        out = F.when(unescape(x["head"]) == role, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((acc["at"] + len(START) + x["chars"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return formatted.withColumn("loss_spans", F.aggregate(parts, zero, step, lambda acc: acc["out"]))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and -1, read back from what was formatted; null roles and texts are empty, null ids are one."""
    from corvane.llm.common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = with_loss(format_conversations(rows.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
