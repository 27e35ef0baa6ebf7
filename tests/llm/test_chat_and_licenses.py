import hashlib
import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, licenses

TEXTS = ["plain", "", None, "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<|im_start|>", "100% %25 %3C", "%0A", "a <| b |>", "line\nline\n", "<|im_end|", "<", "é\U0001f600", "<|im_start|>user", "\n", "x<|im_end|>"]


def test_round_trip(spark):
    rows = [(i, t, r, x) for i, x in enumerate(TEXTS) for t, r in enumerate(["user", "assistant", None, "we<|im_end|>ird\nrole%"])]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, x in enumerate(TEXTS):
        assert [(t["role"], t["text"]) for t in out[i]["turns"]] == [(r or "", x or "") for r in ["user", "assistant", None, "we<|im_end|>ird\nrole%"]]
        assert out[i]["formatted"].count("<|im_start|>") == 4 and out[i]["formatted"].count("<|im_end|>") == 4


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "100% sure"), (1, 1, "assistant", "a<|im_end|>b")]
    text = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert text == "<|im_start|>user\n100% sure<|im_end|>\n<|im_start|>assistant\na%3C|im_end|>b<|im_end|>\n"


def test_order_ties_and_odd_tables(spark):
    rows = [(1, 1, "b", "2"), (1, 1, "a", "1"), (1, None, "c", "0"), (1, 1, "a", "1"), (None, 0, "user", "x")]
    out = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {1: ["0", "1", "1", "2"], None: ["x"]}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, piece string")).count() == 0


def test_query_adds_the_conversation(spark, sf):
    row = chat.op10_chat_format(spark, sf).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said))
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


@pytest.mark.parametrize("change", [lambda s: s, str.upper, lambda s: "Copyright (c) 2020 Some Body\n\n" + s.replace(",", " ;"), lambda s: s.replace("sublicense", "sub-license").replace(" ", "\n  "), lambda s: "MIT Licence\n\n" + s])
def test_licence_variants(spark, change):
    docs = spark.createDataFrame([(1, change(licenses._MIT))], "doc_id long, text string")
    assert licenses.scan(docs, licenses.known_digests(spark)).where("line = 0").first()["license"] == "MIT"


def test_licence_notices_and_odd_tables(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "Some prose.\nreleased UNDER the MIT licence\nmore"), (2, licenses._MIT + " but changed"), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    out = {(r["doc_id"], r["line"], r["license"]) for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert out == {(1, 0, None), (1, 2, "MIT"), (2, 0, None), (3, 0, "CC-BY-NC-4.0"), (3, 1, "CC-BY-NC-4.0")}
    known = licenses.known_digests(spark)
    found = licenses.scan(odd_docs, known)
    assert found.where("line = 0").count() == odd_docs.count() and found.where(F.col("license").isNotNull()).count() == 0
    assert licenses.scan(no_docs, known).count() == 0


def test_licences_on_one_line(spark):
    """Texts that don't name themselves are found on a line of a document as well."""
    texts = [("ISC", licenses._ISC), ("BSD-2-Clause", licenses._BSD_GRANT + licenses._BSD_ITEMS + licenses._BSD_END), ("Zlib", licenses._ZLIB), ("Unlicense", licenses._UNLICENSE)]
    docs = spark.createDataFrame([(i, f"A title\n\n{t}\nmore") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    out = licenses.scan(docs, licenses.known_digests(spark)).where("line > 0").collect()
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in out) == [(i, 3, n) for i, (n, _) in enumerate(texts)]


def test_whole_licence_files(spark):
    """Files that the system has are found by digest, as they are and in other case, spacing and copyright lines."""
    folder = Path("/usr/share/common-licenses")
    files = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    have = [(f, n) for f, n in files.items() if (folder / f).exists()]
    if not have:
        pytest.skip("no licence files")
    rows = []
    for f, n in have:
        text = (folder / f).read_text()
        rows += [(n, text), (n, "Copyright (c) 2031 A Name\n" + text.upper().replace("\n", "\r\n  ")), (None, text + " but changed")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    out = licenses.scan(docs, licenses.known_digests(spark)).where("line = 0").collect()
    assert {r["doc_id"]: r["license"] for r in out} == {i: n for i, (n, _) in enumerate(rows)}


def test_loss_spans_hold_the_assistant_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>b"), (1, 2, "user", ""), (1, 3, "assistant", "é\n"), (1, 4, "assistant", ""), (2, 0, "user", "x")]
    done = chat.loss_spans(chat.with_loss(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    out = {r["conv_id"]: r for r in done.collect()}
    cut = [out[1]["formatted"][x["start"] : x["end"]] for x in out[1]["loss_spans"]]
    assert cut == ["a%3C|im_end|>b", "é\n", ""] and out[1]["loss"] == ["a<|im_end|>b", "é\n", ""] and out[2]["loss_spans"] == []


HEADERS = [
    "Copyright The Foo Authors", "Copyright Jane Doe <jane@doe.example>", "Copyright (c) 2019-2021, Jane Doe", "© Foo Inc.", "Copyright: Foo Ltd", "(c) Jane Doe",
    "Copyright by the contributors", "Portions copyright Jane Doe", "// Copyright 2020 Foo. All rights reserved.", "All rights reserved.", "Copyright © Foo", "copyright the foo project authors",
]


def test_copyright_lines_of_any_form(spark):
    """Every licence under every header and heading is known, whatever width it is wrapped to."""
    rows = [(f"{n}/{i}/{j}", f"{h}\n\n{c}\n\n" + textwrap.fill(t, 26 + 7 * ((i + j) % 9), break_long_words=False)) for n, t, heads in licenses.HEADINGS for i, h in enumerate(heads) for j, c in enumerate(HEADERS)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.known_digests(spark)).where("line = 0").collect()
    assert len(out) == len(rows) and [r["doc_id"] for r in out if r["license"] != r["doc_id"].split("/")[0]] == []


def test_words_after_copyright_stay(spark):
    """Wherever a licence breaks its lines, nothing of it but its own copyright lines is taken for one."""
    texts = [t for _, t, _ in licenses.HEADINGS] + [x.read_text(errors="replace") for x in Path("/usr/share/common-licenses").glob("*") if x.is_file()]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    broken = F.regexp_replace("text", r"(?<=[a-z,;.\"'”“])\s+(?=[\"“]?(?i:copyright)\s+(?!owner\])\p{L})", "\n")  # not within the line that names the owner
    assert docs.where(licenses.canonical(F.col("text")) != licenses.canonical(broken)).count() == 0


def test_licence_sql_has_the_same_rows(spark, tmp_path):
    """The rule of copyright lines, told twice, on texts that the tables lack."""
    lines = [*HEADERS, "copyright holders be liable", "Copyright", "Copyright the", "Copyright the \n Foo", "copyright, and", "Copyright the Software, and", "Copyright Notice Inc", "copyrighted by x", "x copyright Jane", "COPYRIGHT HOLDER OR", "© ", "Portions of it"]
    rows = [(i, f"{x}\n{licenses._MIT}\n{y}") for i, (x, y) in enumerate((x, y) for x in lines for y in ("", "SPDX-License-Identifier: MIT"))]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    documents.to_parquet(tmp_path / "documents.parquet")
    with duckdb.connect() as db:
        db.register("documents", documents)
        want = db.sql(licenses.ORACLE).fetchall()
    got = licenses.op1_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["line"], r["digest"], r["license"] or "") for r in got) == sorted((a, b, c, d or "") for a, b, c, d in want)
