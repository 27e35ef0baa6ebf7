import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import gate, history, learning, transcript
from corvane.sources import cards, logs, transcripts
from corvane.streaming import sessions

ENTRY = "session_id string, idx int, role string, text string, tool_errors array<string>"


@pytest.mark.parametrize(("text", "hit"), [("No, use the other one", True), ("that is wrong again", True), ("I said tabs, not spaces", True), ("there is no problem", False), ("Don't do that", True), ("khong phai the", True), ("nothing here", False)])
def test_correction(spark, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(transcript.is_correction(F.col("t"))).first()[0] is hit


def test_windows(spark):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", "plain words", []) for i in range(40)]
    rows[6] = ("s", 6, "user", "no, wrong", [])
    rows[9] = ("s", 9, "assistant", "x", ["Interrupted by user"])
    rows[30] = ("s", 30, "assistant", "x", ["exit 1"])
    entries = spark.createDataFrame(rows, ENTRY)
    out = transcript.capped(transcript.merged(transcript.triggers(entries))).orderBy("start").collect()
    assert [(r["start"], r["end"], r["reason"]) for r in out] == [(4, 11, "rejection"), (28, 32, "tool_error")]
    assert transcript.window_entries(transcript.merged(transcript.triggers(entries)), entries).count() == 13


def test_cap_keeps_corrections(spark):
    rows = [("s", 10 * i, 10 * i + 2, "tool_error") for i in range(40)] + [("s", 500, 504, "correction")]
    out = transcript.capped(spark.createDataFrame(rows, "session_id string, start int, end int, reason string")).collect()
    assert len(out) == 12 and "correction" in {r["reason"] for r in out} and min(r["start"] for r in out) == 290


def test_repeats(spark):
    said = "please always run the linter before committing changes"
    rows = [("s", 0, "user", said, []), *(("s", i, "assistant", "ok", []) for i in range(1, 6)), ("s", 6, "user", said + " now", []), ("t", 0, "user", said, []), ("t", 2, "user", said, [])]
    assert [tuple(r) for r in transcript.repeats(spark.createDataFrame(rows, ENTRY)).collect()] == [("s", 6)]


@pytest.mark.parametrize(
    ("user", "assistant", "hit"),
    [("do it", "so bump the version without the matching changelog entry here", True), ("bump the version without the matching changelog entry", "I bump the version without the matching changelog entry", False), ("x", "unrelated words that say something quite different", False)],
)
def test_attribution(spark, user, assistant, hit):
    card = spark.createDataFrame([("c", "active", "Changelog", "never bump the version without the matching changelog entry", "")], "id string, status string, title string, summary string, body string")
    rows = spark.createDataFrame([("s", 0, "user", user, []), ("s", 1, "assistant", assistant, [])], ENTRY)
    given = spark.createDataFrame([("s", "c")], "session_id string, card_id string")
    assert bool(learning.attributed(given, card, rows).collect()) is hit


def test_work_units(spark):
    hour = 3600
    rows = [("r", "m", "a", 0, ["x"]), ("r", "m", "b", 10 * hour, ["x", "y"]), ("r", "m", "c", 20 * hour, ["z"]), ("r", "m", "d", 100 * hour, ["z"]), ("r", "m", "e", 101 * hour, [])]
    out = history.work_units(spark.createDataFrame(rows, "repo string, branch string, sha string, time long, dirs array<string>")).orderBy("nth").collect()
    assert [(r["n"], r["dirs"]) for r in out] == [(2, ["x", "y"]), (1, ["z"]), (1, ["z"])]


def test_drift(spark):
    rows = [("alpha", "same", "a\nb\n"), ("beta", "same", "a  \n\nb"), ("alpha", "super", "a\nb\nc"), ("beta", "super", "a\nb"), ("alpha", "div", "a\nb"), ("beta", "div", "a\nc"), ("gamma", "solo", "x")]
    out = {r["name"]: r for r in history.drift(spark.createDataFrame([(r, "agent", n, c) for r, n, c in rows], "repo string, kind string, name string, content string")).collect()}
    assert {n: r["class"] for n, r in out.items()} == {"same": "identical", "super": "superset", "div": "diverged", "solo": "unique"}
    assert out["super"]["canonical"] == "alpha" and out["div"]["similarity"] == pytest.approx(1 / 3, abs=1e-6)


def test_numstat(spark):
    lines = ["@ab12|100|fix: a|b", "3\t1\tsrc/a.go", "-\t-\timg.png", "", "@cd34|200|feat: x", "1\t0\tpkg/sub/b.go"]
    out = logs.numstat(spark.createDataFrame([("r", i, v) for i, v in enumerate(lines)], "repo string, line_no int, value string")).collect()
    assert [(r["sha"], r["subject"], r["path"], r["added"]) for r in out] == [("ab12", "fix: a|b", "src/a.go", 3), ("ab12", "fix: a|b", "img.png", 0), ("cd34", "feat: x", "pkg/sub/b.go", 1)]


def test_dependencies(spark):
    files = [("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", ["github.com/a/b"]), ("package.json", '{"dependencies": {"left": "1", "right": "2"}}', ["left", "right"]), ("requirements.txt", "numpy>=1\n# c\npandas\n", ["numpy", "pandas"])]
    out = spark.createDataFrame([(n, c) for n, c, _ in files], "n string, c string").select(logs.dependencies(F.col("c"), F.col("n")).alias("d")).collect()
    assert [r["d"] for r in out] == [d for _, _, d in files]


def test_transcript_readers(spark):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "hello"}}, {"type": "summary"}, {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "part"}, {"type": "tool_result", "is_error": True, "content": "boom"}]}},
    ]
    rows = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(lines)] + [("s", 9, "not json")], "session_id string, line_no int, value string")
    assert [(r["idx"], r["text"], r["tool_errors"]) for r in transcripts.message_entries(rows).orderBy("idx").collect()] == [(0, "hello", []), (1, "part", ["boom"])]
    items = [
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}}, {"type": "event"},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context>x"}]}},
        {"type": "response_item", "payload": {"type": "function_call_output", "success": False, "output": "bad"}},
    ]
    rows = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(items)], "session_id string, line_no int, value string")
    assert [(r["role"], r["text"], r["tool_errors"]) for r in transcripts.rollout_entries(rows).orderBy("idx").collect()] == [("user", "hi", []), ("assistant", "", ["bad"])]


def test_card_files(spark, tmp_path):
    for path, raw in {
        "rules/a.md": "---\ntitle: Wrap Go errors\nscope: [global]\nsummary: wrap errors with package prefix\n---\nAlways wrap.\n", "lessons/b.md": "---\ntitle: B\ntriggers:\n  keywords: [rebase]\nodd: 1\n---\nFirst line\nmore\n",
        "skills/x/SKILL.md": "---\ntitle: X\n---\nskill\n", "skills/x/other.md": "---\ntitle: no\n---\n", ".git/c.md": "---\ntitle: no\n---\n", "rules/bad.md": "no title",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(raw)
    files = cards.card_files(spark, str(tmp_path))
    out = {r["path"]: r for r in cards.read_cards(files).collect()}
    assert set(out) == {"rules/a.md", "lessons/b.md", "skills/x/SKILL.md"}
    a, b = out["rules/a.md"], out["lessons/b.md"]
    assert (a["id"], a["type"], a["summary"], a["body"]) == ("rules/a", "rule", "wrap errors with package prefix", "Always wrap.")
    assert (b["summary"], b["scopes"], b["trig_kw"], b["status"]) == ("First line", ["global"], ["rebase"], "active") and out["skills/x/SKILL.md"]["id"] == "skills/x"
    again = cards.render_cards(cards.read_cards(files)).withColumn("mtime", F.lit(0).cast("long")).withColumn("size", F.length("raw").cast("long"))
    back = {r["path"]: r for r in cards.read_cards(again).collect()}
    assert all(back[p][k] == out[p][k] for p in out for k in ("id", "type", "title", "summary", "scopes", "body", "trig_kw", "status", "baseline"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", 1, "add rate limiting to the webhook endpoint handler", ""), ("s", 2, "add the rate limiting to webhook endpoint handler now", ""), ("t", 1, "yes", ""), ("t", 2, "write a migration adding the invoices table", "")]
    pd.DataFrame(rows, columns=["session_id", "ts", "prompt", "source"]).to_parquet(tmp_path / "p.parquet")
    schema = "session_id string, ts long, prompt string, source string"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    q = sessions.gated(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {(r["session_id"], r["ts"], r["reason"]) for r in spark.sql("select * from gated").collect()}
    batch = {(r["session_id"], r["ts"], r["reason"]) for r in gate.gated(spark.read.schema(schema).parquet(str(tmp_path / "p.parquet"))).collect()}
    assert live == batch and ("s", 2, "novelty") in live
