import math

import pytest
from pyspark.sql import functions as F

from turnloom.llm import mixing
from turnloom.llm.mixing import divergence, entropy, mix_by_temperature, mix_to_targets, plan_targets, temperature_weights, tilt

DOC, GOAL = "doc_id long, source string, n_tokens long", "source string, target_bp int, max_repeats int"


def test_temperature_meets_the_entropy():
    tokens = {"a": 700, "b": 200, "c": 100}
    for share in (0.75, 0.9, 0.99):
        a, w = temperature_weights(tokens, share * math.log(3))
        assert 0 < a < 1 and entropy(w) == pytest.approx(share * math.log(3), abs=1e-9)
        assert w["a"] / w["b"] == pytest.approx(3.5**a)
    assert temperature_weights({}, 1.0) == (1.0, {})


def test_tilt_runs_from_shares_to_targets():
    p, q = {"a": 0.7, "b": 0.3}, {"a": 0.2, "b": 0.8}
    assert tilt(p, q, 0) == pytest.approx(p) and tilt(p, q, 1) == pytest.approx(q)
    falling = [divergence(q, tilt(p, q, x / 10)) for x in range(11)]
    assert falling == sorted(falling, reverse=True)


def test_plan():
    goals = [{"source": s, "target_bp": bp, "max_repeats": r} for s, bp, r in (("a", 5000, 1), ("b", 4000, 2), ("c", 1000, 3))]
    plan = {r["source"]: r for r in plan_targets({"a": 900, "b": 100}, 1000, goals).rows}
    assert plan["a"]["budget"] == 500 and plan["a"]["exponent"] == 1 and plan["a"]["weight"] == 0.5
    assert plan["b"]["budget"] == 200 and 0 < plan["b"]["exponent"] < 1
    assert plan["c"]["budget"] == 0


def test_the_repetition_limit_binds_the_exponent():
    """Where a source stops, its weight is just what its repeats allow; a target met exactly isn't a shortfall."""
    tokens = {"a": 700, "b": 200, "c": 100}
    goals = [{"source": s, "target_bp": bp, "max_repeats": r} for s, bp, r in (("a", 2000, 1), ("b", 4000, 2), ("c", 4000, 3))]
    plan = {r["source"]: r for r in plan_targets(tokens, 1000, goals).rows}
    assert plan["a"]["exponent"] == plan["b"]["exponent"] == 1 and plan["b"]["budget"] == 400
    x = plan["c"]["exponent"]
    p, q = {s: n / 1000 for s, n in tokens.items()}, {"a": 0.2, "b": 0.4, "c": 0.4}
    assert 0 < x < 1 and tilt(p, q, x)["c"] == pytest.approx(0.3) and plan["c"]["budget"] == 300
    none = plan_targets({"a": 10}, 10, [{"source": "a", "target_bp": 10_000, "max_repeats": 0}]).rows[0]
    assert none["exponent"] == 0 and none["budget"] == 0


def test_mixture(spark):
    rows = [(i, [" A", "a", "B", "c"][i % 4], 10 + i % 7) for i in range(4000)] + [(9001, None, 50), (9002, "other", 50), (9003, "a", None), (9004, "b", 0)]
    goals = spark.createDataFrame([("a", 2000, 1), ("b", 6000, 4), ("c ", 2000, 1)], GOAL)
    df = spark.createDataFrame(rows, DOC).withColumn("h", F.lit(1)).withColumn("block", F.lit("clash")).withColumn("budget", F.lit(0))
    uses, report = mix_to_targets(df, goals)
    got = {r["source"]: r for r in report.collect()}
    total = sum(n or 0 for *_, n in rows)
    assert not any(r["falls_short"] for r in got.values())
    for s, share in (("a", 0.2), ("b", 0.6), ("c", 0.2)):
        assert 0 <= share * total - got[s]["used_tokens"] <= 20 and got[s]["actual_share"] == pytest.approx(share, abs=1e-3) and 0 <= share - got[s]["share_of_total"] <= 20 / total
    counts = uses.groupBy("source").agg(F.min("n_uses").alias("lo"), F.max("n_uses").alias("hi"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    assert all(r["hi"] - r["lo"] <= 1 and r["n"] == r["d"] and r["hi"] <= 4 for r in counts)


def test_edges(spark):
    goals = spark.createDataFrame([("a", 10000, 2)], GOAL)
    uses, report = mix_to_targets(spark.createDataFrame([], DOC), goals)
    assert uses.count() == 0 and not report.first()["falls_short"]
    uses, report = mix_to_targets(spark.createDataFrame([(1, "b", 5)], DOC), goals)
    assert uses.count() == 0 and report.first()["falls_short"]
    uses, report = mix_to_targets(spark.createDataFrame([(1, "a", 5), (2, "b", 95)], DOC), goals)
    assert [(r["doc_id"], r["n_uses"]) for r in uses.collect()] == [(1, 2)] and report.first()["falls_short"]
    assert mix_by_temperature(spark.createDataFrame([], DOC))[1].count() == 0


def test_temperature_respects_repeats(spark):
    rows = [(i, "big", 100) for i in range(200)] + [(1000 + i, "tiny", 10) for i in range(5)]
    uses, report = mix_by_temperature(spark.createDataFrame(rows, DOC), 0.99, 3)
    assert uses.agg(F.max("n_uses")).first()[0] <= 3
    assert {r["source"]: r["exponent"] for r in report.collect()}["tiny"] <= 1


def test_shortfall_comes_from_the_mixture(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(100)], DOC)
    goals = spark.createDataFrame([("a", 2000, 1), ("b", 8000, 1)], GOAL)
    assert {r["source"]: r["falls_short"] for r in mix_to_targets(docs, goals)[1].collect()} == {"a": False, "b": True}
    spend = mixing.spend
    monkeypatch.setattr(mixing, "spend", lambda *a, **k: spend(*a, **k).where("doc_id <> 1"))
    with pytest.raises(ValueError, match="b: 490 tokens used"):
        mix_to_targets(docs, goals)
    monkeypatch.setattr(mixing, "spend", spend)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="targets"):
        mix_to_targets(docs, goals.unionByName(goals.withColumn("source", F.lit("c"))))
