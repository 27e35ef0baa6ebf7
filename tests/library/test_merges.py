"""Spans between markers, byte cuts, loose JSON, scopes of paths, and the queue's ladder."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import gate, queue, scope, spans, transcript

OWNER = spans.OWNER


def h8(s):
    return hashlib.sha256(s.replace("\r\n", "\n").strip().encode()).hexdigest()[:8]


def span(id_, text, hash_=None):
    return f"<!-- {OWNER}:begin id={id_} hash={hash_ or h8(text)} -->\n{text}\n<!-- {OWNER}:end id={id_} -->\n"


def merge(spark, content, *sections):
    files = spark.createDataFrame([("f", content)], "path string, content string")
    rows = spark.createDataFrame([("f", k, *s) for k, s in enumerate(sections)], "path string, nth int, id string, markdown string")
    return tuple(spans.merge_spans(files, rows).first())[1:]


def test_spans(spark):
    head, tail = "# Title\n\nmine\n", "more of mine, no line end"
    assert merge(spark, head + span("a", "old") + tail, ("a", "new\n")) == (head + span("a", "new") + tail, ["a"], [])
    assert merge(spark, head + span("a", "old") + tail, ("a", "old")) == (head + span("a", "old") + tail, [], [])
    edited = head + span("a", "edited by hand", h8("old")) + span("b", "b1")
    assert merge(spark, edited, ("a", "new"), ("b", "b2"), ("c", "c1")) == (head + span("a", "edited by hand", h8("old")) + span("b", "b2") + "\n" + span("c", "c1"), ["b", "c (new)"], ["a"])
    assert merge(spark, tail, ("x", " text "), ("", "no id"), ("y", " \n ")) == (tail + "\n\n" + span("x", "text"), ["x (new)"], [])
    assert merge(spark, None, ("x", "1"), ("y", "$1 \\2")) == ("\n" + span("x", "1") + "\n" + span("y", "$1 \\2"), ["x (new)", "y (new)"], [])
    crlf = (head + span("a", "old")).replace("\n", "\r\n")
    assert merge(spark, crlf, ("a", "new")) == (head.replace("\n", "\r\n") + span("a", "new"), ["a"], [])
    assert merge(spark, head + span("a", "old")) == (head + span("a", "old"), [], [])


def test_merging_again_changes_nothing(spark):
    sections = [("a", "one\ntwo"), ("b", "x" * 50)]
    once = merge(spark, "intro", *sections)[0]
    assert merge(spark, once, *sections) == (once, [], [])


def test_cuts_in_bytes(spark):
    texts = ["", "plain", "é" * 9, "日本語テキスト", "a\U0001f600b\U0001f600c", "x\ny\nz"]
    for n in range(1, 13):
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.cut_bytes(F.col("x"), n).alias("cut"), t.truncated(F.col("x"), n).alias("line")).collect()
        for r in rows:
            assert r["cut"] == r["x"].encode()[:n].decode(errors="ignore")
            line = r["x"].replace("\n", " ¶ ")
            assert r["line"] == (line if len(line.encode()) <= n else line.encode()[:n].decode(errors="ignore") + "…")


def test_rendering_stops_at_the_first_overflow(spark):
    sections = [("s", 1, "a" * 10), ("s", 2, "é" * 6), ("s", 3, "b"), ("t", 1, "c" * 30), ("u", 1, "d")]
    rows = spark.createDataFrame(sections, "k string, n int, section string")
    assert dict(map(tuple, transcript.byte_capped(rows, "k", "n", 21, "END").collect())) == {"s": "a" * 10 + "END", "t": "END", "u": "d"}
    assert dict(map(tuple, transcript.byte_capped(rows, "k", "n", 23, "END").collect()))["s"] == "a" * 10 + "é" * 6 + "b"


def test_windows_as_text(spark):
    entries = [("s", 0, "user", "no, wrong\nagain", []), ("s", 1, "assistant", "", ["boom" * 100]), ("s", 2, "user", "x" * 700, [])]
    windows = spark.createDataFrame([("s", 0, 1, "correction"), ("s", 2, 2, "repeated")], "session_id string, start int, end int, reason string")
    rows = spark.createDataFrame(entries, "session_id string, idx int, role string, text string, tool_errors array<string>")
    one = "--- window 1 (correction) ---\nuser: no, wrong ¶ again\ntool_error: " + "boom" * 75 + "…\n"
    two = "--- window 2 (repeated) ---\nuser: " + "x" * 600 + "…\n"
    assert transcript.rendered(windows, rows, 5000).first()["text"] == one + two
    assert transcript.rendered(windows, rows, len(one.encode()) + 5).first()["text"] == one + "--- (further windows truncated) ---\n"


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', "1"), ('Sure!\n```json\n{"a": 2}\n``` bye', "2"), ('{"a": {"b": "}"}} x', '{"b":"}"}'), ("[1]", None), ("none", None), ('{"a": 1', None), ("} {", None), ('x {"a": 1} {"b": 2}', None), ('{"a":1},{"b":2}', None), ('{"a":1}],[{"b":2}', None), ('{"a":1}},{"b":2}', None), ("", None), (None, None)])
def test_loose_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(F.to_json(F.try_variant_get(t.loose_json(F.col("s")), "$.a", "variant"))).first()[0] == want


def test_scopes_of_paths(spark):
    roots = [("/w/app", "ref: refs/heads/feat/x\n"), ("/w/app/sub/deep", "0123456789abcdef\n"), ("/w/bare", None)]
    files = [("/w/app", "requirements.txt"), ("/w/app", "go.mod"), ("/w/app", "pyproject.toml"), ("/w/app", "README.md"), ("/w/app/sub/deep", "pom.xml")]
    cwds = ["/w/app", "/w/app/x/y", "/w/app/sub/deep/z", "/w/apple", "/", "/w/bare/q", "/w/app/" + "/".join("abcdefghijklmnopqrstuvwxyz")]
    out = scope.detected(spark.createDataFrame([(c,) for c in cwds * 2], "cwd string"), spark.createDataFrame(roots, "root string, head string"), spark.createDataFrame(files, "root string, file string"))
    got = {r["cwd"]: r["allowed"] for r in out.collect()}
    app = ["global", "repo:app", "branch:app@feat/x", "lang:go", "lang:python"]
    none = lambda c: ["global", "dir:" + hashlib.sha256(c.encode()).hexdigest()[:8]]
    assert got == {cwds[0]: app, cwds[1]: app, cwds[2]: ["global", "repo:deep", "branch:deep@01234567", "lang:java"], cwds[3]: none(cwds[3]), "/": none("/"), cwds[5]: ["global", "repo:bare"], cwds[6]: none(cwds[6])}


def test_queue_equals_a_plain_fold(spark):
    rng = random.Random(2)
    events, jobs = [], {}
    for seq in range(400):
        kind, source, session, path = rng.choice(("enqueue", "fail", "fail", "done")), rng.choice(("", "codex", "claude")), rng.choice("ab"), rng.choice(("p", "q", ""))
        events.append((seq, seq * 10, kind, source, session, path, "stop"))
        key = (source or "claude") + session + path
        if not path:
            continue
        if kind == "enqueue":
            jobs[key] = ["queued", 0, seq * 10]
        elif key in jobs and jobs[key][0] == "queued":
            if kind == "done":
                jobs[key][0] = "done"
            else:
                jobs[key][1] += 1
                jobs[key][0] = "parked" if jobs[key][1] == queue.ATTEMPTS else "queued"
        if seq in (60, 399):
            rows = spark.createDataFrame(events, "seq long, ts long, kind string, source string, session_id string, transcript_path string, trigger string")
            states = queue.job_states(rows)
            assert {r["job"]: [r["state"], r["attempts"], r["enqueued_at"]] for r in states.collect()} == {hashlib.sha256(k.encode()).hexdigest()[:16]: v for k, v in jobs.items()}
            waiting = sorted((v[2] for v in jobs.values() if v[0] == "queued"), reverse=True)
            assert [r["enqueued_at"] for r in queue.next_jobs(states, 2).collect()] == waiting[:2]


def test_words_of_a_configuration_extend_the_gate(spark):
    rows = spark.createDataFrame([("Được  rồi nhé!", ""), ("refactor the billing export worker", "refactor billing import worker")], "p string, l string")
    plain = [r[0] for r in rows.select(gate.gate(F.col("p"), F.col("l"))).collect()]
    more = [r[0] for r in rows.select(gate.gate(F.col("p"), F.col("l"), acks=("được  rồi NHÉ", " "), stop_words=("Export", "import"))).collect()]
    assert (plain, more) == ([None, None], ["ack", "novelty"])


def test_pattern_needs_its_own_line():
    assert not re.search(spans.span_pattern().replace("(?msd)", "(?ms)"), "x " + span("a", "b").replace("\n", " "))
