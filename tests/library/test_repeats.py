import random

from corvane.operators import transcript

WORDS = ["lantern", "harbour", "violet", "granite", "meadow", "copper", "saffron", "willow", "thunder", "marble"]


def brute(turns):
    out = set()
    for s, i, x in turns:
        for s2, j, y in turns:
            if s == s2 and j < i - transcript.REPEAT_GAP and min(len(x), len(y)) >= transcript.REPEAT_TERMS and len(x & y) / len(x | y) >= transcript.REPEAT:
                out.add((s, i))
    return out


def test_repeats_as_by_brute_force(spark):
    rng = random.Random(3)
    turns = [(s, i, set(rng.sample(WORDS, rng.randint(3, 8)))) for s in range(6) for i in range(30)]
    rows = [(s, i, "user", " ".join(sorted(x, key=lambda w: rng.random())), []) for s, i, x in turns]
    entries = spark.createDataFrame(rows, "session_id long, idx int, role string, text string, tool_errors array<string>")
    got = {tuple(r) for r in transcript.repeats(entries).collect()}
    assert got == brute(turns) and 0 < len(got) < len(turns)


def test_many_equal_turns(spark):
    """Twenty thousand copies in one session make one row of the join, and each is found."""
    entries = spark.range(20_000).selectExpr("1L as session_id", "cast(id as int) as idx", "'user' as role", f"'{' '.join(WORDS)}' as text", "array('') as tool_errors")
    assert transcript.repeats(entries).count() == 20_000 - 4
    assert transcript.repeats(entries.limit(0)).count() == 0


def test_repeats_over_tasks_and_parts(spark, monkeypatch):
    """Small and large sessions (one without an id too) in many tasks: as by brute force, and no row of the plan is a pair of turns."""
    monkeypatch.setattr(transcript, "TASK_TERMS", 60)
    monkeypatch.setattr(transcript, "TURNS", 16)
    rng = random.Random(5)
    words = WORDS + [f"w{i}" for i in range(12)]
    bases = [rng.sample(words, 9) for _ in range(12)]
    edited = lambda x: {w for w in x if rng.random() < 0.85} | set(rng.sample(words, rng.randint(0, 3)))
    turns = [(s, i, edited(rng.choice(bases))) for s, n in (("a", 90), ("b", 40), ("c", 7), ("d", 5)) for i in range(n)]
    turns += [("e", i, set(WORDS)) for i in range(50)]
    rows = [(s, i, "user", " ".join(sorted(x, key=lambda w: rng.random())), []) for s, i, x in turns] + [(None, i, "user", " ".join(WORDS), []) for i in range(9)]
    entries = spark.createDataFrame(rows, "session_id string, idx int, role string, text string, tool_errors array<string>")
    found = transcript.repeats(entries)
    assert found.dtypes == [("session_id", "string"), ("idx", "int")]
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute(turns) and len(got) == len(set(got)) and 60 < len(got) < len(turns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "posexplode" not in plan
