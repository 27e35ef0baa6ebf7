"""Streams with state: growing transcripts, rising forms, and the throttle of readings."""

import datetime as dt
import hashlib
import json
import random
import time

import pytest

from corvane.sources import incremental, transcripts
from corvane.streaming import sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def line(text):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}}) + "\n"


def test_growing_transcripts_are_read_once(spark, tmp_path):
    folder, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    folder.mkdir()

    def run():
        rows = transcripts.grown_entries(incremental.growing_lines(spark, str(folder), part="40"))
        rows.writeStream.format("parquet").option("checkpointLocation", str(ck)).trigger(availableNow=True).start(str(out)).awaitTermination(120)
        return sorted((r["session_id"], r["text"]) for r in spark.read.parquet(str(out)).collect())

    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_text(line("one") + line("é" * 60) + line("cut off")[:20])
    (folder / "c.txt").write_text(line("no transcript"))
    want = [("a", "one"), ("a", "é" * 60)]
    assert run() == want
    assert run() == want  # a restart without news gives nothing again
    a.write_text(line("one") + line("é" * 60) + line("cut off") + "no json\n")
    b.write_text(line("other"))
    want = sorted(want + [("a", "cut off"), ("b", "other")])
    assert run() == want
    a.write_text(line("new"))  # shorter than what was read: replaced
    b.unlink()
    want = sorted(want + [("a", "new")])
    assert run() == want
    a.write_text(line("new") + line("more"))
    b.write_text(line("back"))  # gone and back: read from its start
    assert run() == sorted(want + [("a", "more"), ("b", "back")])


@pytest.mark.parametrize("part", ["3", "64", "100000"])
def test_split_files_give_each_line_once(spark, tmp_path, part):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 40) for _ in range(25)]
    (tmp_path / "a.jsonl").write_text("\n".join(texts) + "\nlast without an end")
    rows = incremental.growing_lines(spark, str(tmp_path), stream=False, part=part).orderBy("offset").collect()
    assert [r["value"] for r in rows] == texts
    data = (tmp_path / "a.jsonl").read_bytes()
    assert all(data[r["offset"] :].startswith(r["value"].encode() + b"\n") for r in rows)


def in_batches(spark, folder, frames, schema, build, forever):
    """Rows of a stream whose files are read one a batch."""
    folder.mkdir()
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"in/{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    query, until = build(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start(str(folder / "out")), time.time() + 60
    n = sum(map(len, frames))
    # with a clock of its own, a query has batches without rows for ever
    while query.isActive and time.time() < until and (forever is False or sum(p.numInputRows for p in query.recentProgress) < n):
        time.sleep(0.3)
    query.stop()
    return spark.read.parquet(str(folder / "out")).collect()


def test_forms_rise_the_same_in_any_batches(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("st"), rng.choice("abc"), seq, rng.randint(1, 3)) for seq in range(60)]
    best, want = {}, set()
    for s, c, seq, level in rows:
        want.add((s, c, seq, level, level > best.get((s, c), 0)))
        best[s, c] = max(best.get((s, c), 0), level)
    for k, cuts in enumerate(([60], [2, 31, 60])):
        frames = [rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        got = in_batches(rocks, tmp_path / str(k), frames, "session_id string, card_id string, seq long, level int", sessions.upgrades, True)
        assert {tuple(r) for r in got} == want and len(got) == 60


def test_readings_are_throttled(rocks, tmp_path):
    minute = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    kib = 1 << 10
    events = [
        ("s", "p", minute(0), 10 * kib, "stop"),  # too little
        ("s", "p", minute(1), 20 * kib, "stop"),  # enough, and never read
        ("s", "p", minute(3), 50 * kib, "stop"),  # must wait until minute 11
        ("s", "p", minute(5), 60 * kib, "stop"),
        ("t", "q", minute(6), kib, "session-end"),  # the end of a session waits for nothing
        ("t", "q", minute(7), kib, "session-end"),  # but has nothing new
        ("s", "", minute(8), 99 * kib, "stop"),
        ("s", "p", minute(30), 61 * kib, "stop"),
        ("s", "p", minute(31), 62 * kib, "session-end"),
        ("u", "r", minute(90), kib, "stop"),
    ]
    want = {("s", 20 * kib, minute(1), "stop"), ("s", 60 * kib, minute(11), "stop"), ("t", kib, minute(6), "session-end"), ("s", 62 * kib, minute(31), "session-end")}
    for k, cuts in enumerate(([10], [3, 5, 10])):
        frames = [events[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        got = in_batches(rocks, tmp_path / str(k), frames, "session_id string, transcript_path string, ts timestamp, size long, trigger string", sessions.flushes, False)
        assert {(r["session_id"], r["size"], r["at"], r["trigger"]) for r in got} == want and len(got) == 4
        assert {r["job"] for r in got if r["session_id"] == "s"} == {hashlib.sha256(b"claudesp").hexdigest()[:16]}
