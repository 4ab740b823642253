import random

import pytest
from pyspark.sql import functions as F

from turnloom.llm.splits import components, grouped_splits

EDGE = "a string, b string"


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def labelled(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["label"], set()).add(r["vertex"])
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(str(rng.randrange(120)), str(rng.randrange(120))) for _ in range(90)], "path": [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "star": [("hub", str(i)) for i in range(150)]}[kind]
    df = spark.createDataFrame([*edges, *edges[:10], ("solo", "solo"), (None, "x"), ("x", None)], EDGE)
    assert labelled(components(df)) == brute([*edges, ("solo", "solo")])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], EDGE)).count() == 0
    assert labelled(components(spark.createDataFrame([("a", "a")], EDGE))) == [["a"]]


def test_splits_keep_related_records_together(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, f"l{rng.randrange(150)}"]), rng.choice([None, f"s{rng.randrange(400)}"])) for i in range(600)]
    rows += [(1000 + i, "big", f"s{400 + i}") for i in range(300)] + rows[:5] + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "rid long, lin string, ses string").withColumn("split", F.lit("old")).withColumn("label", F.lit("clash")).withColumn("w", F.lit(1))
    out, _, report = grouped_splits(df, ["lin", "ses"], {"train": 0.6, "validation": 0.2, "test": 0.2})
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [*[c for c in df.columns if c != "split"], "split"]
    for k in ("lin", "ses"):
        seen = {}
        for r in got:
            if r[k] is not None:
                assert seen.setdefault(r[k], r["split"]) == r["split"]
    assert len({r["split"] for r in got if r["lin"] == "big"}) == 1
    share = {r["split"]: r["n_records"] for r in report.collect()}
    assert sum(share.values()) == len(rows) and min(share.values()) > 0


def test_empty_records(spark):
    out, labels, report = grouped_splits(spark.createDataFrame([], "rid long, lin string"), ["lin"], {"train": 1, "test": 1})
    assert out.count() == labels.count() == 0 and report.count() == 2


def test_shares_are_met_without_large_components(spark):
    df = spark.range(4000).select(F.concat(F.lit("g"), F.col("id") % 1000).alias("g"), "id")
    report = grouped_splits(df, ["g"], {"train": 0.8, "validation": 0.1, "test": 0.1})[2]
    assert all(abs(r["n_records"] / 4000 - r["share"]) < 0.02 for r in report.collect())
