import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import labels as lb
from turnloom.operators import metrics as mt

ROW = "g string, frame long, y int, score double"


def frame(spark, groups):
    return spark.createDataFrame([(g, i, y, float(s)) for g, (ys, ss) in groups.items() for i, (y, s) in enumerate(zip(ys, ss, strict=True))], ROW)


GROUPS = {"good": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "bad": ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9]), "one": ([1, 1], [0.3, 0.4]), "none": ([0, 0], [0.3, 0.4]), "tie": ([0, 1], [0.5, 0.5])}


def test_goldens(spark):
    df = frame(spark, GROUPS)
    auc = {r["g"]: r["auroc"] for r in mt.auroc(df, ["g"]).collect()}
    assert auc == {"good": 1.0, "bad": 0.0, "one": None, "none": None, "tie": 0.5}
    ap = {r["g"]: r["ap"] for r in mt.average_precision(df, ["g"], ["frame"]).collect()}
    assert ap["good"] == 1.0 and ap["one"] is None and ap["none"] is None and ap["tie"] == 0.5
    f1 = {r["g"]: (r["threshold"], r["f1"]) for r in mt.best_f1(df, ["g"]).collect()}
    assert f1["good"] == (0.8, 1.0) and f1["one"] == (None, None)
    pr = {r["g"]: r["precision_at_recall"] for r in mt.precision_at_recall(df, ["g"], ["frame"], 0.5).collect()}
    assert pr["good"] == 1.0 and pr["none"] is None
    with pytest.raises(ValueError):
        mt.precision_at_recall(df, ["g"], ["frame"], 0.0)
    t = {r["g"]: (r["precision"], r["recall"], r["f1"]) for r in mt.at_threshold(df, ["g"], 0.85).collect()}
    assert t["good"] == pytest.approx((1.0, 0.5, 2 / 3)) and t["none"] == (None, None, None)


def test_against_pairs(spark):
    rng = random.Random(1)
    ys = [int(rng.random() < 0.3) for _ in range(300)]
    ss = [rng.choice([rng.randrange(-20, 20) / 10, rng.uniform(-2, 2)]) for _ in ys]
    df = frame(spark, {"x": (ys, ss)})
    pos, neg = [s for s, y in zip(ss, ys, strict=True) if y], [s for s, y in zip(ss, ys, strict=True) if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for step in (0.01, 0.7, 100.0):
        assert mt.auroc(df, ["g"], step=step).first()["auroc"] == pytest.approx(want)
    order = sorted(range(300), key=lambda i: (-ss[i], i))
    hits, ps = 0, []
    for k, i in enumerate(order, 1):
        hits += ys[i]
        if ys[i]:
            ps.append(hits / k)
    assert mt.average_precision(df, [], ["frame"], step=0.3).first()["ap"] == pytest.approx(sum(ps) / len(ps))


def test_range_labels(spark):
    frames = spark.createDataFrame([("s", t, 1000) for t in range(80, 1040, 80)] + [(None, 80, 1000)], "session_id string, t_end_ms long, duration_ms long")
    events = spark.createDataFrame([("s", "bc", 400), ("s", "bc", 800), ("t", "bc", 100)], "session_id string, kind string, t_ms long")
    for r in lb.horizon_labels(frames.where("session_id is not null"), events, ["bc", "ts"], [80, 240]).collect():
        t, h = r["t_end_ms"], r["horizon_ms"]
        assert t + h <= 1000 and r["y"] == int(r["kind"] == "bc" and any(t < e <= t + h for e in (400, 800)))
    seen = lb.next_event(frames, events, ["session_id"], slice_ms=100).collect()
    assert len(seen) == 13 and {r["t_end_ms"]: r["next_ms"] for r in seen if r["session_id"]}[400] == 800


def test_label_columns_against_rows(spark):
    """Every measure of several label columns at once equals the measure of one label column; slices and repeats don't matter."""
    rng = random.Random(6)
    frames = [(s, f, rng.choice([0.1, 0.2, 0.35, 0.5, rng.random()]), (f + 1) * 80) for s in "abc" for f in range(rng.randint(20, 60))]
    ends = {s: max(t for q, _, _, t in frames if q == s) for s in "abc"}
    events = [(rng.choice("abcd"), rng.choice(["ts", "bc"]), rng.randint(0, 5000)) for _ in range(40)]
    f = spark.createDataFrame([*frames, (None, 1, 0.5, 160), ("a", 999, 0.5, None)], "session_id string, frame long, score double, t_end_ms long")
    e = spark.createDataFrame([*events, *events[:5], (None, "ts", 200), ("a", "ts", None)], "session_id string, kind string, t_ms long")
    lengths = spark.createDataFrame(list(ends.items()), "session_id string, duration_ms long")
    kinds, horizons = ["ts", "bc"], [80, 400]
    flags = lb.horizon_flags(f, e, kinds, horizons, lengths)
    got = {(r["session_id"], r["frame"]): tuple(r[f"y{i}"] for i in range(4)) for r in flags.collect()}
    assert len(got) == len(frames) + 2
    for s, n, _, t in frames:
        for i, (k, h) in enumerate(lb.flag_names(kinds, horizons)):
            want = None if t + h > ends[s] else int(any(q == s and kk == k and t < at <= t + h for q, kk, at in events))
            assert got[s, n][i] == want
    flags = flags.where("session_id is not null and t_end_ms is not null").cache()
    ys = [f"y{i}" for i in range(4)]
    value = lambda df, n, *c: {(r["session_id"], r["which"]): tuple(None if r[x] is None else round(r[x], 9) for x in c) for r in df.collect() if r["which"] == n}
    for i, y in ((1, "y1"), (2, "y2")):
        one = flags.where(f"{y} is not null").withColumnRenamed(y, "y").withColumn("which", F.lit(i))
        g, t = ["session_id", "which"], ["frame"]
        for many, single, c in (
            (mt.auroc_each(flags, g[:1], ys), mt.auroc(one, g), ["auroc", "n_pos", "n_neg"]),
            (mt.average_precision_each(flags, g[:1], t, ys), mt.average_precision(one, g, t), ["ap"]),
            (mt.precision_at_recall_each(flags, g[:1], t, 0.5, ys), mt.precision_at_recall(one, g, t, 0.5), ["precision_at_recall"]),
            (mt.at_threshold_each(flags, g[:1], 0.3, ys), mt.at_threshold(one, g, 0.3), ["tp", "fp", "fn", "precision", "recall", "f1"]),
            (mt.best_f1_each(flags, g[:1], ys), mt.best_f1(one, g).where("f1 is not null"), ["threshold", "precision", "recall", "f1"]),
            (mt.counts_each(flags, g[:1], ys), mt.counts(one, g), ["n_chunks", "n_pos", "n_neg"]),
        ):
            assert value(many, i, *c) == value(single, i, *c), c
    empty = flags.where("false")
    assert mt.auroc_each(empty, ["session_id"], ys).count() == 0 and mt.best_f1_each(empty, [], ys).count() == 0


def test_precedence(spark):
    a = spark.createDataFrame([("x", 1)], "session_id string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "session_id string, v int")
    assert sorted((r["session_id"], r["v"], r["priority"]) for r in lb.by_precedence([a, b]).collect()) == [("x", 1, 0), ("y", 3, 1)]
