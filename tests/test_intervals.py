import random

import __spark_entry__ as entry

from turnloom.operators import intervals as iv
from turnloom.plans import views as v

SPAN = "session_id string, speaker string, start_ms long, end_ms long"


def test_worked_example(spark):
    rows = [("s", "user", 0, 2000), ("s", "assistant", 2100, 3500), ("s", "user", 2400, 2700), ("s", "user", 4000, 6000), ("s", "assistant", 4500, 6500)]
    got = iv.classify_starts(spark.createDataFrame(rows, SPAN)).orderBy("start_ms").collect()
    assert [r["kind"] for r in got] == [None, "turn_shift", "backchannel", "turn_shift", "barge_in"]


def test_classes_against_pairs(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice("st"), rng.choice("abc"), a, a + rng.randrange(50, 1500)) for a in (rng.randrange(0, 200) * 50 for _ in range(160))})
    want = {}
    for s, p, a, b in rows:
        others = [r for r in rows if r[0] == s and r[1] != p]
        covering = any(r[2] <= a < r[3] for r in others)
        recent = any(0 <= a - r[3] <= 250 for r in others)
        before = sorted((r for r in rows if r[0] == s and r[2] < a), key=lambda r: (-r[3], -r[2], r[1]))
        short = b - a <= 600
        want[(s, p, a, b)] = "backchannel" if covering and short else "barge_in" if covering else "backchannel" if recent and short else "turn_shift" if before and before[0][1] != p else None
    for slice_ms in (700, 600_000):
        got = {tuple(r)[:4]: r["kind"] for r in iv.classify_starts(spark.createDataFrame(rows, SPAN), slice_ms=slice_ms).collect()}
        assert got == want


def test_merge_and_reject(spark):
    rows = [("s", "u", 0, 10), ("s", "u", 10, 20), ("s", "u", 30, 40), ("t", "u", 0, 10), ("t", "u", 5, 20)]
    df = spark.createDataFrame(rows, SPAN)
    assert sorted((r["start_ms"], r["end_ms"]) for r in iv.merge_touching(df, ["session_id"]).collect()) == [(0, 20), (30, 40)]
    assert [tuple(r) for r in iv.overlapping_keys(df, ["session_id"]).collect()] == [("t", 1)]


def test_checkpoint_golden(spark):
    user = spark.createDataFrame([("s", "user", 0, 1000), ("s", "user", 2000, 3000)], SPAN)
    agent = spark.createDataFrame([("s", "assistant", 1400, 1800)], SPAN)
    length = spark.createDataFrame([("s", 4000)], "session_id string, duration_ms long")
    points = iv.checkpoints(iv.episodes(user), length, [240, 480, 960])
    got = iv.stab(points, agent, "session_id", "cutoff_ms", "busy").orderBy("cutoff_ms").collect()
    assert [(r["episode"], r["busy"], r["right_censored"]) for r in got] == [(0, False, False), (0, True, False), (0, False, False), (1, False, True), (1, False, True), (1, False, True)]
    on_time = iv.checkpoints(iv.episodes(user), length, [1000])
    assert [r["episode"] for r in on_time.collect()] == []  # exactly at the resumption, and at the end


def test_stab_keeps_rows_with_nulls(spark):
    points = spark.createDataFrame([("s", 5), ("s", None), (None, 5), ("s", 5), ("s", 20)], "session_id string, at long")
    spans = spark.createDataFrame([("s", "u", 0, 20), (None, "u", 0, 99)], SPAN)
    got = sorted((str(r["session_id"]), str(r["at"]), r["hit"]) for r in iv.stab(points, spans, "session_id", "at", "hit").collect())
    assert got == [("None", "5", False), ("s", "20", False), ("s", "5", True), ("s", "5", True), ("s", "None", False)]


def test_frames_of_intervals(spark):
    df = spark.createDataFrame([("s", "u", 0, 160), ("s", "u", 150, 161), ("s", "u", -100, -10)], SPAN)
    assert sorted(r["frame"] for r in iv.interval_frames(df, ["session_id"], 80).collect()) == [0, 1, 2]


def test_no_session_is_lost_to_overlaps(spark, tiny):
    q = entry.queries()
    t = v.turns(spark, tiny)
    assert not t.select("session_id", "speaker").distinct().exceptAll(q["win_03_periods"](spark, tiny).select("session_id", "speaker").distinct()).count()
    users = t.where("speaker = 'user'").select("session_id").distinct().count()
    for name in ("win_04_period_episodes", "stm_03_period_censored"):
        assert q[name](spark, tiny).select("session_id").distinct().count() == users
    seen = q["win_05_period_checkpoints"](spark, tiny).select("session_id").distinct().count()
    assert seen == users > q["win_05_checkpoints"](spark, tiny).select("session_id").distinct().count()
