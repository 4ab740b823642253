import hashlib
import random
from collections import Counter

import pytest

from turnloom.operators import agreement as ag
from turnloom.operators import resample as rs
from turnloom.operators import sampling as sp
from turnloom.operators import validation as va


def ratings(spark, groups):
    rows = [(i, str(k), x, x if x != "unratable" else None) for i, g in enumerate(groups) for k, x in enumerate(g)]
    return spark.createDataFrame(rows, "item long, annotator string, raw_action string, action string")


def plain_alpha(groups):
    """1 - observed / expected disagreement, pair by pair."""
    kept = [[x for x in g if x != "unratable"] for g in groups]
    kept = [g for g in kept if len(g) > 1]
    every = [x for g in kept for x in g]
    n = len(every)
    observed = sum(sum(x != y for i, x in enumerate(g) for j, y in enumerate(g) if i != j) / (len(g) - 1) for g in kept) / max(n, 1)
    expected = sum(x != y for i, x in enumerate(every) for j, y in enumerate(every) if i != j) / max(n * (n - 1), 1)
    return 1 - observed / expected if expected else None


def test_alpha(spark):
    rng = random.Random(12)
    answers = ["ack", "repair", "respond", "wait", "unratable"]
    cases = [[rng.choices(answers, [3, 1, 2, 6, 1], k=rng.randint(1, 5)) for _ in range(rng.randint(2, 9))] for _ in range(6)]
    cases += [[["ack"] * 3, ["ack"] * 2], [["repair"], ["wait"]], [["repair"] * 4, ["ack"] * 2, ["wait", "unratable"]]]
    for groups in cases:
        rows = ag.krippendorff(ratings(spark, groups), []).collect()
        want = plain_alpha(groups)
        assert (rows[0]["alpha"] if rows else None) == (want if want is None else pytest.approx(want)), groups


def test_positive_agreement_and_confusion(spark):
    r = ratings(spark, [["wait", "wait"], ["wait", "respond"]])
    got = {x["action"]: x["agreement"] for x in ag.positive_agreement(r, []).collect()}
    assert got == {"wait": pytest.approx(2 / 3), "respond": 0.0, "ack": None, "repair": None}
    pairs = {(x["a"], x["b"]): x["pairs"] for x in ag.confusion(r, []).collect()}
    assert len(pairs) == 16 and pairs[("wait", "wait")] == 2 and pairs[("wait", "respond")] == pairs[("respond", "wait")] == 1


def test_onsets(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, False), (1, 1.5, 3.0, False), (1, None, None, True), (2, None, None, None)], "item long, earliest double, latest double, waits boolean")
    r = ag.onset_disagreement(df, []).first()
    assert (r["compared_pairs"], r["finite_pairs"], r["earliest_mad"], r["latest_mad"], r["mismatches"]) == (3, 1, 0.5, 1.0, 2)
    assert r["mismatch_rate"] == pytest.approx(2 / 3)


def test_majority_and_repeats(spark):
    r = ratings(spark, [["wait", "wait", "ack"], ["unratable", "unratable", "ack"], ["wait", "ack", "repair"]])
    got = {x["item"]: (x["outcome"], x["action"]) for x in ag.majority(r).collect()}
    assert got == {0: ("resolved", "wait"), 1: ("excluded", None), 2: ("unresolved", None)}
    rows = spark.createDataFrame([("a", 1, False, "wait"), ("a", 1, True, "wait"), ("a", 2, True, "ack"), ("b", 1, True, "ack"), ("b", 1, False, "wait")], "annotator string, item long, is_repeat boolean, raw_action string")
    r = ag.repeat_consistency(rows).first()
    assert (r["repeats"], r["paired"], r["agreed"], r["unpaired"], r["consistency"]) == (3, 2, 1, 1, 0.5)


def test_bootstrap_equals_a_plain_recomputation(spark):
    import numpy as np

    units = {f"u{i:02d}": (float(i * i % 7), float(1 + i % 3)) for i in range(11)}
    df = spark.createDataFrame([(k, *v) for k, v in units.items()], "k string, vw double, w double")
    got = {r["b"]: r["value"] for r in rs.bootstrap(df, "k", ["vw", "w"], rs.weighted_mean(), 40, 5).collect()}
    names = sorted(units)
    for b in range(40):
        at = [int(hashlib.sha256(f"5:{b}:{i}".encode()).hexdigest()[:15], 16) % 11 for i in range(11)]
        assert got[b] == pytest.approx(sum(units[names[j]][0] for j in at) / sum(units[names[j]][1] for j in at))
    ci = rs.interval(rs.bootstrap(df, "k", ["vw", "w"], rs.weighted_mean(), 40, 5)).first()
    assert (ci["lo"], ci["hi"]) == pytest.approx(tuple(np.quantile(list(got.values()), [0.025, 0.975])))


def plain_pilot(rows, size, least, seed):
    """The greedy choice without any cut of the candidates."""
    digest = lambda r: hashlib.sha256(f"{seed}:pilot:{r[1]}:{r[5]}".encode()).hexdigest()
    cell, source, stratum, line, episodes, out = Counter(), Counter(), Counter(), Counter(), set(), []
    while len(out) < size:
        pool = [r for r in rows if r[1] not in episodes]
        if len(line) < least:
            pool = [r for r in pool if r[2] not in line] or pool
        r = min(pool, key=lambda r: (cell[r[3], r[4]], source[r[3]], stratum[r[4]], line[r[2]], digest(r), r[1], r[5]))
        cell[r[3], r[4]] += 1
        source[r[3]] += 1
        stratum[r[4]] += 1
        line[r[2]] += 1
        episodes.add(r[1])
        out.append(r[0])
    return out


def test_pilot_against_the_plain_choice(spark):
    rng = random.Random(3)
    rows = [(str(i), f"e{i // 2}", f"l{(i // 2) % 17}", "ab"[(i // 2) % 2], rng.choice("xyz"), rng.choice([0.24, 0.5, 2.0])) for i in range(240)]
    df = spark.createDataFrame(rows, "item string, episode string, lineage string, source string, stratum string, elapsed double")
    for size, least in ((6, 3), (20, 12)):
        got = sp.balanced_pilot(df.repartition(5), size, least, 1).orderBy("place").collect()
        assert [r["item"] for r in got] == plain_pilot(rows, size, least, 1)
    for size, least in ((200, 3), (40, 18)):
        with pytest.raises(Exception, match="are needed"):
            sp.balanced_pilot(df, size, least, 1).collect()
    assert sp.balanced_pilot(df, 200, 3, 1, partial=True).count() == 120
    assert sp.balanced_pilot(df.where("false"), 5, 3, 1, partial=True).count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(str(i), f"l{i % 9}") for i in range(18)], "item string, lineage string")
    got = sp.assign(df, list("pqrstuv"), 3, 1).collect()
    assert Counter(r["item"] for r in got) == {str(i): 3 for i in range(18)}
    line = {(r["annotator"], int(r["item"]) % 9) for r in got}
    assert len(line) == len(got) == 54  # nobody has two items of a lineage
    load = Counter(r["annotator"] for r in got)
    assert max(load.values()) - min(load.values()) <= 2
    with pytest.raises(Exception, match="can't keep"):
        sp.assign(df, list("pqrst"), 3, 1).collect()
    again = sp.with_repeats(spark.createDataFrame(got), 0.05, 1)
    assert again.where("is_repeat").count() >= 7
    for names in ([f"e{i % 3}" for i in range(12)], ["a"] * 5 + ["b"] * 2, ["a"] * 4 + ["b", "c", "d"], []):
        queue = sp.spaced_queue(spark.createDataFrame([("a", str(i), e) for i, e in enumerate(names)], "annotator string, item string, episode string"), 1).orderBy("place").collect()
        assert [r["place"] for r in queue] == list(range(len(names))) and {r["item"] for r in queue} == {str(i) for i in range(len(names))}
        touching = sum(x["episode"] == y["episode"] for x, y in zip(queue[:-1], queue[1:], strict=True))
        top = max(Counter(names).values(), default=0)
        assert touching == max(0, top - (len(names) - top) - 1)


def test_validation(spark):
    df = spark.createDataFrame([("s", 0, 10, 1), ("s", 5, 12, 2), ("s", 20, 20, 1), ("t", 0, 99, 1)], "k string, a long, b long, c int")
    assert sorted(r["reason"] for r in va.broken_intervals(df.withColumn("d", df.a * 0 + 50), "k", "a", "b", "d").collect()) == ["empty", "out of range", "overlaps"]
    assert [r["k"] for r in va.duplicates(df, ["k"]).collect()] == ["s"] == [r["k"] for r in va.broken_dependencies(df, "k", ["c"]).collect()]
    assert sorted((r["k"], r["side"]) for r in va.coverage(df.where("k = 's'"), df.where("k = 't'"), ["k"]).collect()) == [("s", "missing"), ("t", "unexpected")]
    assert [tuple(r) for r in va.mismatches(df.where("k = 't'"), df.where("k = 't'").withColumn("c", df.c + 1), ["k"], ["a", "c"]).collect()] == [("t", "c")]
