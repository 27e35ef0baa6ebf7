import datetime as dt

from pyspark.sql import functions as F

from corvane.functions import display as d
from corvane.operators import learning


def test_expressions(spark):
    now = dt.datetime(2024, 1, 2)
    row = spark.createDataFrame([("text\n**Evidence:** seen twice\n**Reinforced 2x**\nend", "confirm: lesson a", "keep <!-- x:begin h -->\nspan\n<!-- x:end -->\nrest", ["a", "b", "c"], now - dt.timedelta(hours=5))], "body string, s string, m string, ids array<string>, ts timestamp")
    out = row.select(
        d.evidence(F.col("body")).alias("e"), d.without_markers(F.col("body")).alias("w"), d.subject_parts(F.col("s")).alias("p"), d.owned_spans(F.col("m"), "x").alias("o"), d.without_spans(F.col("m"), "x").alias("n"),
        d.short_list(F.col("ids")).alias("l"), d.ago(F.col("ts"), F.lit(now)).alias("a"), d.percent(F.lit(12.5)).alias("c"), d.dollars(F.lit(1234.5)).alias("u"), d.call_cost(F.lit(1000), F.lit(0), F.lit("big-model"), {"small": (1.0, 1.0), "big": (2.0, 2.0)}).alias("k"),
        d.tolerant_time(F.lit("2024-01-02T03:04:05.000Z")).alias("t1"), d.tolerant_time(F.lit("2024-01-02 03:04:05")).alias("t2"), d.tolerant_time(F.lit("x")).alias("t3"),
    ).first()
    assert (out["e"], out["w"], tuple(out["p"]), out["o"], out["n"]) == ("seen twice", "text\nend", ("confirm", "lesson a"), ["span"], "keep rest")
    assert (out["l"], out["a"], out["c"], out["u"], out["k"]) == ("a, b +1 more", "5h", "13%", "$1,234.50", 0.002)
    assert out["t1"] == out["t2"] and out["t3"] is None


def test_lessons(spark):
    cols = "id string, type string, title string, summary string, body string, status string"
    cards = spark.createDataFrame([("c", "lesson", "run the linter first", "always run the linter before commits", "Run it. Always.", "active")], cols)
    new = spark.createDataFrame([("a", "lesson", "run the linter first", "always run the linter before commits", "Run it.", ""), ("b", "lesson", "run linter first", "always run the linter before commits", "New words.", ""), ("d", "lesson", "quite another matter", "nothing alike", "x", "")], cols)
    assert {tuple(r) for r in learning.merged_lessons(new, cards).collect()} == {("a", "c", "skip"), ("b", "c", "append"), ("d", None, "create")}
    queued = spark.createDataFrame([("p1",)], "transcript_path string")
    assert learning.already_queued(spark.createDataFrame([("p1",), ("p2",)], "transcript_path string"), queued, queued).count() == 1
    threads = spark.createDataFrame([(1, "i", "p", 5), (2, "j", "p", 1)], "db_version int, id string, path string, updated_at long")
    assert learning.newest_threads(threads).first()["id"] == "j"
    assert spark.range(1).select(learning.valid_scope(F.lit("repo:x"), F.lit("r"))).first()[0] == "repo:x" and spark.range(1).select(learning.valid_scope(F.lit("all"), F.lit("r"))).first()[0] == "repo:r"
