import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return True


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


TRICKY = [
    "a@b.c..d@e.f a@b.c%x@y.z @b.c a@b a@b. a.b@c-d.e-f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111--1111 4111111111111111x4111111111111111",
    "+1 (988) 555-2485 +1+2+34567890123 +49.30.1234567-", "4" * 30 + " 0" * 20 + "-0" * 14, "é\U0001f600 x@y.zz 10.0.0.1\n+1 234 567 8901", "a@" + "b." * 20000 + "c", "9" * 20000, "a" * 50000, None, "",
]


def test_base_spans_equal_plain_patterns(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    for row in pii.base_spans(docs).collect():
        assert {k: [(x["start"], x["end"]) for x in row[f"_{k}"]] for k in BASE} == brute(row["text"])


def test_query(spark, sf):
    rows = pii.op4_pii_sanitise(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        found = brute(texts[r["doc_id"]])
        spans = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [len(found[k]) for k in BASE]
        assert r["spans"].startswith(spans)


@pytest.fixture
def telling(spark):
    """The term `zorblatt` stands near one address, in several contexts, and nowhere else; `common` is everywhere."""
    rows = [(i, f"text {i} common words number{i} zorblatt wrote from jo@ex.org today common item{i}") for i in range(5)]
    rows += [(10 + i, f"common words of another text {i} and item{i} number{i} today wrote from") for i in range(60)]
    rows += [(100, "Zorblatt alone, common words"), (101, "zorblatts and axzorblatt differ")]
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")


def test_disclosing_terms(telling):
    terms = {r["term"]: r["share"] for r in pii.disclosing_terms(telling).collect()}
    # 5 of 67 texts have the address, 6 the term: log2(67 * 5 / (5 * 6)) / log2(67 / 5)
    assert set(terms) == {"zorblatt"} and terms["zorblatt"] == pytest.approx(0.92975, abs=1e-4)
    out = {r["doc_id"]: r for r in pii.sanitise(telling).collect()}
    assert out[0]["text"] == "text 0 common words number0  wrote from [email] today common item0" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[100]["text"] == " alone, common words" and out[101]["text"] == "zorblatts and axzorblatt differ"


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "same words around jo@ex.org in every copy") for i in range(20)], "doc_id long, text string")
    assert pii.disclosing_terms(docs) is None


def shares(spark, rows):
    found = pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    return {} if found is None else {r["term"]: r["share"] for r in found.collect()}


OTHER = [f"common words of another text {i} stand here. They are common" for i in range(400)]


def test_entities_met_once_are_judged(spark):
    far = "Quimbleton, of whom common words of another text stand here and here and here and here again, has jo@ex.org. Then common words"
    assert set(shares(spark, [*OTHER, far])) >= {"quimbleton"}
    # one chance meeting of a term that many texts have tells nothing
    assert "sometimes" not in shares(spark, [*OTHER, "sometimes common jo@ex.org", *(f"sometimes common {i} text" for i in range(40))])


def test_spellings_are_one_entity(spark):
    rows = [f"text {i} common zorblatt {number} words" for i, number in enumerate(["+1 (988) 555-2485", "+1 988 555 2485", "+19885552485", "+1-988-555-2485"])]
    # four texts have the number and the term, of 404
    assert shares(spark, [*OTHER, *rows])["zorblatt"] == pytest.approx(1.0)
    one = spark.createDataFrame([(r,) for r in rows], "text string")
    assert pii.base_spans(one).select(F.explode(F.transform("_phone", lambda x: pii._entity("phone", x)))).distinct().count() == 1


def test_copies_hide_nothing(spark):
    rows = [f"text {i} common zorblatt wrote from jo@ex.org today item{i}" for i in range(10)]
    assert "zorblatt" in shares(spark, [*OTHER, *rows, *[rows[0]] * 30])
    assert shares(spark, [*OTHER, *rows, *[rows[0]] * 30]) == shares(spark, [*OTHER, *rows])


def test_odd_tables(odd_docs, no_docs):
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r["text"] for r in out.where("doc_id = 1").collect()} == {None}
    assert out.where("doc_id = 8").first()["text"].endswith("mail [email]")
    assert pii.sanitise(no_docs).count() == 0


def test_no_copy_of_a_text_beside_each_of_its_sentences_and_words(spark):
    """A text of 1.4 MB with 40,000 sentences and as many words; a copy of it beside each would take 56 GB."""
    text = " ".join(f"wu{i}x wrote to m{i}@ex.org today." for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing in here"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.all_spans(docs).select("doc_id", F.size("_email").alias("n"), F.size("_term").alias("terms")).collect()}
    assert [out[i]["n"] for i in (1, 2, 3)] == [40_000, 0, 0] and out[2]["terms"] == out[3]["terms"] == 0
