import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import vectors
from corvane.operators import gate


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "folded"),
    [("café crème", "cafe creme"), ("über größer", "uber grosser"), ("señor niño", "senor nino"), ("ação padrão", "acao padrao"), ("żółć łódź", "zolc lodz"), ("xử lý lỗi", "xu ly loi")],
)
def test_fold(spark, given, folded):
    assert one(spark, given, t.fold) == folded


def test_terms(spark):
    assert one(spark, "The retry, the RETRY of Xử lý 中 a b2", t.terms) == ["retry", "xu", "ly", "中", "b2"]
    assert one(spark, "one two three four", lambda s: t.terms(s, 2)) == ["one", "two"]
    assert one(spark, "", t.terms) == []


@pytest.mark.parametrize(("given", "tokens"), [("", 0), ("abcd", 2), ("abc", 1), ("xử lý lỗi", 6)])
def test_token_estimate(spark, given, tokens):
    assert one(spark, given, t.token_estimate) == tokens


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(t.jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 0.0, 1.0]


def test_prose(spark):
    text = "keep `code` and https://x.y/z now\n```\nhidden\n```\nsee /etc/hosts or main.go end\n```\nopen fence hides"
    assert one(spark, text, t.prose).split() == ["keep", "and", "now", "see", "or", "end"]


def plain_prose(s):
    """Line by line, with ASCII classes."""
    kept, fenced = [], False
    for line in s.split("\n"):
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            kept.append(line + "\n")
    out = "".join(kept)
    for pattern in (r"`[^`]*`", r"https?://[^\t\n\f\r ]+", r"~?/[\w./@-]+", r"\b[\w-]+\.[a-z]{2,4}\b"):
        out = re.sub(pattern, " ", out, flags=re.ASCII)
    return out


FENCES = [
    "a\n```py\nhidden é\n```\nb `c` d", "a\n  ```\nopen é main.go", "é\n\u3000```\nhidden\n\u3000``` x\nafter", "a\r```\rb main.go\n\r```\nhidden\r\n```\r\nend", "x\u2028```\ny\n",
    "émain.go maiñ.go main.goé -a.bc é-a.bc", "https://é.x/é\u00a0z ~/é/ü /a.b/é", "```", "```\n```", "``` ```\nx\n```", "", "a ``` b\nc ``` d", "``` a\n``` b\n``` c",
]


def test_prose_equals_plain_prose(spark, sf):
    from corvane.plans import catalogue

    rows = spark.createDataFrame([(s,) for s in FENCES], "s string")
    for row in rows.select("s", t.prose(F.col("s")).alias("p")).collect():
        assert row["p"].rstrip("\n") == plain_prose(row["s"]).rstrip("\n"), row["s"]
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = catalogue.prose_pages(spark, sf).collect()
    assert len(found) == len(pages) > 0
    for row in found:
        want = plain_prose(pages[row["page_id"]])
        want = want if pages[row["page_id"]].endswith("\n") and row["chars"] == len(want) else want.removesuffix("\n")
        assert row["chars"] == len(want) and row["digest"] == hashlib.md5(want.encode()).hexdigest()


def test_shingles(spark):
    assert one(spark, "one two three four sixsix seven", t.shingles) == ["one two three four sixsix", "two three four sixsix seven"]
    assert one(spark, "all of it is so", t.shingles) == [] and one(spark, "too few words", t.shingles) == []


def test_slug_and_phrases(spark):
    assert one(spark, "  Hello, World! -- ok", t.slug) == "hello-world-ok" and one(spark, "!!", t.slug) == "card"
    assert one(spark, "DON'T, you  dare!", t.plain_phrases) == "dont you dare"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.dot(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0, 0.0]
    assert rows.select(vectors.unit(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize(
    ("prompt", "last", "reason"),
    [
        ("yes", "", "ack"), ("OK!", "", "ack"), ("  lgtm  ", "", "ack"), ("tiep tuc", "", "ack"), ("làm đi", "", "ack"), ("/commit --pr", "", "slash"), ("fix it", "", "short"),
        ("add rate limiting to the webhook endpoint", "", None), ("2026-01-01 ERROR boom\n\tframe\n" * 300, "", "paste"), ("why does this fail?\n" + "2026-01-01 ERROR boom\n\tframe\n" * 300, "", None),
        ("add the rate limiting to webhook endpoint handler now", "add rate limiting to the webhook endpoint handler", "novelty"),
        ("write a migration adding the invoices table with indexes", "add rate limiting to the webhook endpoint handler", None),
    ],
)
def test_gate(spark, prompt, last, reason):
    rows = spark.createDataFrame([(prompt, last)], "p string, l string")
    assert rows.select(gate.gate(F.col("p"), F.col("l"))).first()[0] == reason
