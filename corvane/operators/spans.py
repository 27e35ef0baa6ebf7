"""Files with spans of our own between markers: new sections are merged in, and what others wrote stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = "corvane"
_EDGE = r"[\s\x85\p{Z}]"


def span_pattern(owner: str = OWNER) -> str:
    """A span with its id, the hash of what was last written and what stands there now; lines may end in CRLF."""
    return rf"(?msd)^<!-- {owner}:begin id=([A-Za-z0-9_-]+) hash=([0-9a-f]+) -->\r?\n(.*?)^<!-- {owner}:end id=[A-Za-z0-9_-]+ -->\r?\n?"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{_EDGE}+|{_EDGE}+\z", "")


def content_hash(s: Column) -> Column:
    """Eight digits that don't change with line ends and white space around a text."""
    return F.substring(F.sha2(stripped(F.replace(s, F.lit("\r\n"), F.lit("\n"))), 256), 1, 8)


def render_span(id_: Column, content: Column, owner: str = OWNER) -> Column:
    begin, end = F.concat(F.lit(f"<!-- {owner}:begin id="), id_), F.concat(F.lit(f"<!-- {owner}:end id="), id_, F.lit(" -->\n"))
    return F.concat(begin, F.lit(" hash="), content_hash(content), F.lit(" -->\n"), content, F.lit("\n"), end)


def merge_spans(files: DataFrame, sections: DataFrame, owner: str = OWNER) -> DataFrame:
    """(path, content, applied, conflicts) of each file once its sections are merged in.

    files: path, content (null: empty); sections: path, nth, id, markdown, of which those without an id or with a blank text
    are left out. In the order of `nth`: a section whose span isn't there is appended; one whose span was edited (its text
    no longer has the recorded hash) is a conflict and stays; one with the text that stands there changes nothing; any
    other replaces its span. Spans without a section and all text outside of spans stay byte for byte. A file without sections
    stays as it is; of spans with one id the last tells its state, and all are replaced. The sections of a file meet in its row.
    """
    pattern = span_pattern(owner)
    asked = sections.select("path", "nth", "id", stripped(F.coalesce("markdown", F.lit(""))).alias("text")).where("id != '' and text != ''")
    asked = asked.select("path", F.struct("nth", "id", content_hash(F.col("text")).alias("hash"), render_span(F.col("id"), F.col("text"), owner).alias("span")).alias("s"))
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(asked.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("sections")), "path", "left")
    group = lambda k: F.regexp_extract_all("content", F.lit(pattern), F.lit(k))
    spans = F.transform(F.arrays_zip(group(0).alias("whole"), group(1).alias("id"), group(2).alias("was"), group(3).alias("inner")), lambda x: F.struct(x["whole"].alias("whole"), x["id"].alias("id"), x["was"].alias("was"), content_hash(x["inner"]).alias("has")))
    rows = rows.withColumn("spans", spans).withColumn("outside", F.split("content", pattern, -1))

    def judged(s: Column) -> Column:
        have = F.element_at(F.filter("spans", lambda x: x["id"] == s["id"]), -1)
        there = F.exists("spans", lambda x: x["id"] == s["id"])
        action = F.when(~there, "new").when(have["has"] != have["was"], "conflict").when(have["has"] == s["hash"], "same").otherwise("changed")
        return F.struct(s["id"].alias("id"), s["span"].alias("span"), action.alias("action"))

    rows = rows.withColumn("sections", F.transform(F.coalesce("sections", F.array().cast("array<struct<nth:int,id:string,hash:string,span:string>>")), judged))
    of = lambda *kinds: F.filter("sections", lambda s: s["action"].isin(*kinds))
    rows = rows.withColumn("changed", of("changed"))
    new_span = lambda x: F.coalesce(F.get(F.reverse(F.filter("changed", lambda s: s["id"] == x["id"])), F.lit(0))["span"], x["whole"])
    pieces = F.zip_with("outside", F.transform("spans", new_span), lambda o, s: F.concat(o, F.coalesce(s, F.lit(""))))
    added = F.array_join(F.transform(of("new"), lambda s: F.concat(F.lit("\n"), s["span"])), "")
    body = F.array_join(pieces, "")
    gap = F.when((body != "") & ~F.endswith(body, F.lit("\n")) & (added != ""), "\n").otherwise("")
    names = F.transform(of("new", "changed"), lambda s: F.concat(s["id"], F.when(s["action"] == "new", " (new)").otherwise("")))
    return rows.select("path", F.concat(body, gap, added).alias("content"), names.alias("applied"), F.transform(of("conflict"), lambda s: s["id"]).alias("conflicts"))
