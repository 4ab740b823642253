import random

import pytest
from pyspark.sql import functions as F

from turnloom.llm.nearest import nearest_in_time

LEFT, RIGHT = "entity string, id long, t double", "entity string, series string, id long, t double"


def brute(left, right, tolerance):
    out = set()
    for e, i, t in set(left):
        if e is None or i is None or t is None or t != t:
            continue
        best = {}
        for f, s, j, u in set(right):
            if e == f and s is not None and j is not None and u is not None and u == u and abs(u - t) <= tolerance:
                best[s] = min(best.get(s, (9e9,)), (abs(u - t), u, j))
        out |= {(i, s, b[2]) for s, b in best.items()}
    return out


@pytest.mark.parametrize("batch", [3, 10000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, batch):
    rng = random.Random(seed)
    times = lambda: rng.choice([rng.uniform(-3, 25), rng.randrange(100) / 4])
    left = [(rng.choice("ab"), i, times()) for i in range(150)]
    right = [(rng.choice("abc"), rng.choice("xyz"), 1000 + i, times()) for i in range(400)]
    left += left[:9] + [("a", 900, None), ("a", 901, float("nan")), (None, 902, 1.0), ("a", None, 1.0), ("zz", 903, 1.0)]
    right += right[:20] + [("a", "x", 1900, None), (None, "x", 1901, 1.0), ("a", None, 1902, 1.0), ("a", "x", None, 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        a = spark.createDataFrame(left, LEFT).withColumn("series", F.lit(1)).withColumn("slot", F.lit(5))
        b = spark.createDataFrame(right, RIGHT).withColumn("slot", F.lit("s"))
        for slice_s in (1.0, 60.0):
            got = nearest_in_time(a, b, 0.5, slice_s).select("left_id", "series", "right_id").collect()
            assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(left, right, 0.5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_sides(spark):
    a, b = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    one, two = spark.createDataFrame([("a", 1, 1.0)], LEFT), spark.createDataFrame([("a", "x", 2, 1.0)], RIGHT)
    assert nearest_in_time(a, two, 1.0).count() == nearest_in_time(one, b, 1.0).count() == nearest_in_time(a, b, 1.0).count() == 0
    assert nearest_in_time(one, two, 0.0).first()["distance"] == 0.0
    with pytest.raises(ValueError):
        nearest_in_time(one, two, 70.0)


def test_ties(spark):
    left = spark.createDataFrame([("a", 1, 1.0)], LEFT)
    right = spark.createDataFrame([("a", "x", 7, 1.25), ("a", "x", 9, 0.75), ("a", "x", 8, 0.75)], RIGHT)
    assert [r["right_id"] for r in nearest_in_time(left, right, 0.5).collect()] == [8]
