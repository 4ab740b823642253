import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions.columns import bucket, event_kind, half_even, half_up, norm_session, session_from_file, to_ms
from turnloom.operators import timeline as tl


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_ids_kinds_and_rounding(spark):
    ids = {" DC_Ab12:mid180 ": "ab12", "candor_x:first": "x", "x:mid45": "x:mid45", "duplexchat_dc_y": "dc_y", "": None, None: None}
    for given, want in ids.items():
        assert one(spark, norm_session(F.lit(given).cast("string"))) == want
    assert one(spark, session_from_file(F.lit("/a/b/candor_q1_turns.csv"))) == "q1"
    assert [one(spark, event_kind(F.lit(k))) for k in ("Turn Shift", "BC", "overlap", "??")] == ["turn_shift", "backchannel", "barge_in", None]
    assert [one(spark, half_up(F.lit(x))) for x in (0.5, 12.5, 2.49)] == [1, 13, 2]
    assert [one(spark, half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(spark, to_ms(F.lit(x).cast("double"))) for x in (1.2346, float("nan"), float("inf"), None, 1e12, 1e13)] == [1235, None, None, None, 1_000_000_000_000_000, None]
    assert [one(spark, bucket(F.lit(x), [1.0, 3.0])) for x in (0.5, 1.0, 3.0)] == [0, 1, 2]


def test_crop_pool_align(spark):
    s = spark.range(2500).select(F.lit("s").alias("session_id"), F.col("id").alias("frame"), F.col("id").cast("double").alias("value"), F.lit(200_000).alias("duration_ms"))
    mid = tl.crop(s, 180_000, "mid").orderBy("frame").collect()
    assert len(mid) == 2250 and (mid[0]["frame"], mid[0]["value"], mid[-1]["value"]) == (0, 125.0, 2374.0)
    assert tl.crop(s, 300_000, "mid").count() == 0 and tl.too_short(s.limit(1), 300_000).count() == 1
    pooled = tl.pool(s.where("frame < 82"), ["session_id"]).orderBy("frame").collect()
    assert len(pooled) == 20 and pooled[0]["value"] == 1.5
    long = s.where("frame < 10").withColumn("signal_name", F.lit("a")).unionByName(s.where("frame < 8").withColumn("signal_name", F.lit("b")))
    assert tl.align(long, ["a", "b"]).count() == 16 and tl.wide(long, ["a", "b"], ["session_id"]).count() == 8


def test_shift_runs_and_arrays(spark):
    s = spark.range(20).select(F.lit("s").alias("session_id"), F.col("id").alias("frame"), (F.col("id") % 5 < 3).alias("on"))
    assert tl.shifted(s, ["session_id"], "on", 12).count() == 8
    assert sorted(r["n_frames"] for r in tl.runs(s, ["session_id"], "on").where("on").collect()) == [3, 3, 3, 3]
    x = np.random.default_rng(0).normal(size=57)
    v = F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, tl.resample_linear(v, 23)) == pytest.approx(np.interp(np.linspace(0, 56, 23), np.arange(57), x))
    assert one(spark, tl.resample_nearest(v, 23)) == pytest.approx(x[np.linspace(0, 56, 23).astype(int)])
    want = [np.sqrt(np.mean(x[i : i + 10] ** 2)) for i in range(0, 48, 4)]
    assert one(spark, tl.sliding_rms(v, 10, 4)) == pytest.approx(want)
    assert one(spark, tl.sliding_rms(v, 99, 4)) == []


def test_undelay(spark):
    s = spark.createDataFrame([(k, t, float(10 * k + t)) for k in range(3) for t in range(5)], "k int, frame long, value double")
    got = {(r["k"], r["frame"]): r["value"] for r in tl.undelay(s, ["k"], F.col("k")).collect()}
    assert got[(0, 4)] == 4 and got[(2, 0)] == 22 and got[(2, 3)] is None and len(got) == 15
