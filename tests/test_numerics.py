import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnloom.functions import arrays as ar
from turnloom.operators import numerics as nu


def frames(spark, x, group="g"):
    return spark.createDataFrame([(group, i, row.tolist()) for i, row in enumerate(x)], "session_id string, frame long, vec array<double>")


def test_moments(spark):
    x = np.random.default_rng(0).normal(0.3, 1.5, (40, 5))
    r = nu.moments(frames(spark, x), ["session_id"]).first()
    c = np.cov(x.T, bias=True)
    off = c - np.diag(np.diag(c))
    want = ((x.mean(0) ** 2).sum(), ((x.var(0) - 1) ** 2).mean(), (off**2).sum() / 5, 0.5 * (x**2).sum(1).mean())
    assert (r["mean_part"], r["var_part"], r["cov_part"], r["energy"]) == pytest.approx(want)
    single = nu.moments(frames(spark, x[:1]), ["session_id"]).first()
    assert single["var_part"] == single["cov_part"] == 0.0


def test_likelihood(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], 2), ([0.0, float("nan")], 0), ([1.0], 4), (None, 0)], "z array<double>, t int")
    got = [r[0] for r in df.select(ar.nll_of("z", "t")).collect()]
    assert got == [pytest.approx(np.log(np.exp([0, 1, 2]).sum()) - 2), None, None, None]


def test_reduction(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("a", float("nan"), 5.0), ("a", 2.0, 0.0)], "g string, mean double, duration_s double")
    r = nu.reduced(df, ["g"]).first()
    assert (r["unweighted"], r["duration_weighted"], r["duration_s"], r["n_clips"]) == (2.0, 2.5, 45.0, 4)


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    y = np.array(["p", "q", "r"])[np.argmax(x[:, :3], 1)]
    model = nu.softmax_fit(x, y, ["p", "q", "r"], 400)
    got = nu.softmax_scored(frames(spark, x), model, "vec").select("frame", ar.argmax("p").alias("k")).collect()
    assert np.mean([["p", "q", "r"][r["k"]] == y[r["frame"]] for r in got]) > 0.9
    layers = nu.mlp_init([6, 16, 2], 1)
    losses = nu.mlp_fit(layers, x, np.stack([x[:, 0], np.abs(x[:, 1])], 1), steps=600, rate=0.1)
    assert np.mean(losses[-50:]) < 0.5 * np.mean(losses[:20])
    pred = {r["frame"]: r["pred"] for r in nu.predicted(frames(spark, x), layers, "vec").collect()}
    assert pred[7] == pytest.approx(nu.mlp_forward(layers, x)[7].tolist())
    with pytest.raises(ValueError):
        nu.softmax_fit(x, y, ["p", "q", "r", "s"])


def test_projections_do_not_depend_on_partitions(spark):
    df = frames(spark, np.random.default_rng(3).normal(size=(50, 12)))
    a = {r["frame"]: r["proj"] for r in nu.projected(df, "vec", 4, 1).collect()}
    b = {r["frame"]: r["proj"] for r in nu.projected(df.repartition(5), "vec", 4, 1).collect()}
    assert a == b
    q = nu.orthogonal(df, "vec", 12, 1).select(F.round(ar.dot("proj", "proj") - ar.dot("vec", "vec"), 9)).collect()
    assert {r[0] for r in q} == {0.0}


def test_losses_are_of_all_pairs(spark, tiny, monkeypatch):
    train = entry.queries()["ml_03_train"]
    whole = train(spark, tiny).orderBy("lam").collect()
    assert all(r["last_loss"] < r["first_loss"] for r in whole)
    sample = nu.fit_sample
    monkeypatch.setattr(nu, "fit_sample", lambda *a, **k: sample(*a, **k, rows=5))
    cut = train(spark, tiny).orderBy("lam").collect()
    assert [r["first_loss"] for r in cut] == pytest.approx([r["first_loss"] for r in whole])
