import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import metrics as mt
from turnloom.operators.running import neighbour, placed


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_neighbours_and_places_of_a_hot_key(spark, width):
    """One key has half of the rows; whatever the buckets, the answers are those of one sorted list."""
    rng = random.Random(width)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c"]), t, i, rng.choice([None, i])) for i, t in enumerate(rng.sample(range(-400, 900), 300))]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").withColumn("extra", F.lit(1))
    bucket = F.floor(F.col("t") / width)
    for forward in (False, True):
        got = {r["id"]: r["w"] for r in neighbour(df, ["k"], bucket, ["t"], "v", "w", forward).collect()}
        for key in "hot", "a", "b", "c":
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=forward)
            assert [got[r[2]] for r in mine] == [None, *[r[3] for r in mine[:-1]]][: len(mine)]
    got = {r["id"]: r["n"] for r in placed(df, ["k"], bucket, ["t"], "n").collect()}
    for key in "hot", "a":
        assert [got[r[2]] for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])] == list(range(1, 1 + sum(r[0] == key for r in rows)))
    assert placed(df.where("false"), ["k"], bucket, ["t"], "n").count() == 0


def test_quantiles(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice([0.1, 0.25, rng.uniform(-2, 3)]) for _ in range(n)] for g, n in (("x", 1), ("y", 2), ("z", 61))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    for step in (0.05, 10.0):
        for r in mt.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.8, "c": 0.0, "d": 1.0}, step).collect():
            assert [r[c] for c in "abcd"] == pytest.approx(np.quantile(groups[r["g"]], [0.5, 0.8, 0.0, 1.0]).tolist())
