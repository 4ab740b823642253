import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnloom.functions.columns import EVENT_KINDS
from turnloom.operators import synthetic as sy
from turnloom.operators import timeline as tl
from turnloom.plans import compare as cp
from turnloom.plans import views as v


def test_salient_signals_rank_above_random_ones(spark):
    f = sy.salient_frames(spark, 8)
    long = f.select("session_id", "frame", F.explode(F.create_map(F.lit("salience"), F.col("salience"), F.lit("random"), F.col("random"))).alias("signal_name", "value"))
    what = cp.Compare(["salience", "random"], horizons_ms=[1000], replicates=50)
    per = cp.rows(long, sy.events(spark, 8), sy.sessions(spark, 8), what)
    got = {(r["signal_name"], r["kind"]): r for r in cp.summary(per, what).collect()}
    assert len(got) == 2 * len(EVENT_KINDS)
    for kind in EVENT_KINDS:
        good, bad = got[("salience", kind)], got[("random", kind)]
        assert good["auroc"] > 0.7 > 0.6 > bad["auroc"] and good["auroc_ci"]["lo"] <= good["auroc"] <= good["auroc_ci"]["hi"]
        assert good["n_sessions"] <= 8


def test_window_and_common_frames(spark):
    f = sy.salient_frames(spark, 2).select("session_id", "frame", F.col("random").alias("value"), F.lit("a").alias("signal_name"))
    both = f.unionByName(f.where("frame < 500").withColumn("signal_name", F.lit("b")))
    out = cp.labelled(both, sy.events(spark, 2), sy.sessions(spark, 2), cp.Compare(["a", "b"], ["bc"], [80], window_ms=40_000, mode="first"))
    assert out.where("y0 is not null").agg(F.max("frame")).first()[0] == 498  # 500 frames, the last one's horizon isn't observed
    assert out.groupBy("signal_name").count().count() == 2
    with pytest.raises(ValueError):
        cp.Compare([])


def test_synthetic_sessions_are_the_same_everywhere(spark):
    a = sorted(map(tuple, sy.events(spark, 3).collect()))
    assert a == sorted(map(tuple, sy.events(spark, 3).repartition(5).collect())) and len(a) == 45


def test_frames_in_windows_and_resampling(spark):
    f = spark.range(40).where("id <> 17").select(F.lit("s").alias("k"), F.col("id").alias("frame"), (F.col("id") * 1.0).alias("value"))
    places = {r["place"]: r["m"] for r in tl.sliding_frames(f, ["k"], 10, 5, {"m": F.avg("value")}).collect()}
    assert places == {0: 4.5, 1: 9.5, 4: 24.5, 5: 29.5, 6: 34.5}
    assert [r["value"] for r in tl.resampled_nearest(f, ["k"], 4).orderBy("i").collect()] == [0.0, 13.0, 26.0, 39.0]
    assert [r["value"] for r in tl.resampled_linear(f, ["k"], 5).orderBy("i").collect()] == [0.0, 9.75, 19.5, 29.25, 39.0]


def test_every_signal_and_every_pair(spark, tiny):
    f = v.frames(spark, tiny)
    signals = {r[0] for r in f.select("signal_name").distinct().collect()}
    assert len(signals) > 2
    q = entry.queries()
    assert {r["signal_name"] for r in q["agg_01_auroc_by_signal"](spark, tiny).collect()} == signals
    labelled = q["join_05_labels_by_signal"](spark, tiny).select("session_id").distinct()
    assert labelled.count() == f.join(v.spans(spark, tiny), "session_id").where("t_end_ms + 500 <= duration_ms").select("session_id").distinct().count()
    assert {r["pair"] for r in q["compare_report"](spark, tiny).select("pair").distinct().collect()} == {"/".join(p) for p in cp.pairs(f)}
    assert len(cp.pairs(f)) > 1


def _flat(df):
    return {(r["pair"], r["signal_name"], r["kind"], r["horizon_ms"]): [r["auroc"], r["ap"], r["n_sessions"], *(r["auroc_ci"] or [None, None])] for r in df.collect()}


def test_report_of_all_pairs_at_once_is_that_of_each_pair(spark):
    s = sy.salient_frames(spark, 5)
    rounded = F.round(F.col("random"), 1)  # many ties, some below zero
    values = F.create_map(F.lit("a"), F.col("salience"), F.lit("b"), rounded, F.lit("c"), -rounded, F.lit("d"), F.lit(0.5))
    long = s.select("session_id", "frame", F.explode(values).alias("signal_name", "value"))
    long = long.where("not (signal_name = 'b' and frame % 7 = 0) and not (signal_name = 'c' and session_id like '%0') and not (signal_name = 'd' and session_id not like '%1')")
    events, kinds = sy.events(spark, 5), EVENT_KINDS[:2]
    ends = long.groupBy("session_id").agg(((F.max("frame") + 1) * 80).alias("duration_ms"))
    repeated = long.unionByName(long.where("frame % 5 = 0").withColumn("value", F.col("value") - 1))
    settings = {"kinds": kinds, "horizons_ms": [500, 2000]}
    got = _flat(cp.report(repeated, events, 20, **settings))
    split = _flat(cp.report(repeated, events, 20, whole=50, **settings))
    found = cp.pairs(long)
    assert len(found) == 6
    for pair in found[:3] + found[-1:]:
        what = cp.Compare(list(pair), replicates=20, **settings)
        want = _flat(cp.summary(cp.rows(long, events, ends, what), what).withColumn("pair", F.lit("/".join(pair))))
        assert want and {k for k in got if k[0] == "/".join(pair)} == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v) and split[k] == pytest.approx(v)


def test_report_without_pairs_or_rows(spark):
    s = sy.salient_frames(spark, 2).select("session_id", "frame", F.col("random").alias("value"), F.lit("a").alias("signal_name"))
    assert cp.report(s, sy.events(spark, 2), 5).count() == 0
    assert cp.report(s.limit(0), sy.events(spark, 2), 5).count() == 0


def test_report_has_one_plan_for_all_pairs(spark, tiny):
    plan = entry.queries()["compare_report"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 12  # 9; a part for each of three pairs made it 15
