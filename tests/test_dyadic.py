import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.operators import dyadic
from turnloom.operators.dyadic import dyadic_blocks, periods_and_gaps

IV = "session_id string, speaker string, from_ms long, to_ms long"


def brute(rows):
    groups = {}
    for s, p, a, b in rows:
        if None not in (s, p, a, b) and a < b:
            groups.setdefault((s, p), []).append((a, b))
    out = set()
    for key, spans in groups.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1], y[0]) for x, y in zip(merged[:-1], merged[1:], strict=True)}
    return out


@pytest.mark.parametrize("top", [3, 6, 20])
def test_blocks_are_the_interval(top):
    rng = random.Random(top)
    spans = [(a, a + rng.randrange(0, 200)) for a in (rng.randrange(-150, 300) for _ in range(200))] + [(0, 64), (5, 5), (6, 2)]
    where, codes = dyadic_blocks(*np.array(spans).T, top)
    for i, (a, b) in enumerate(spans):
        covered = []
        for code in codes[where == i].tolist():
            start, level = code >> 6, 63 - (code & 63)
            assert start % (1 << level) == 0 and level <= top
            covered += range(start, start + (1 << level))
        assert sorted(covered) == list(range(a, b)) and len(covered) == len(set(covered))
        if top == 20:
            assert (where == i).sum() <= 2 * max(b - a, 1).bit_length()


def test_crowded_cells_and_shared_hashes():
    """Blocks of two cells under one hash, out of which one is thinned while it is read."""
    spans = {("x", 0): [(a, a + 9) for a in range(0, 64, 3)], ("y", 0): [(5, 6), (60, 64)], ("x", 1): [(64, 70), (70, 71)]}
    rows = sorted((7, int(c), k[0]) for k, v in spans.items() for c in dyadic_blocks(*np.array(v).T, 6)[1])
    batches = [pa.record_batch({"k0": [r[2]], "b": [r[1]], "h": [r[0]]}, schema=pa.schema([("k0", pa.string()), ("b", pa.int64()), ("h", pa.int64())])) for r in rows]
    before, dyadic.CROWDED = dyadic.CROWDED, 5
    try:
        got = pa.Table.from_batches(list(dyadic._cells(1, 6)(iter(batches)))).to_pylist()
    finally:
        dyadic.CROWDED = before
    periods = sorted((r["k0"], r["from_ms"], r["to_ms"]) for r in got if r["piece"] in ("period", "edge"))
    assert periods == [("x", 0, 64), ("x", 64, 72), ("y", 5, 6), ("y", 60, 64)]
    assert [(r["k0"], r["from_ms"], r["to_ms"]) for r in got if r["piece"] == "gap"] == [("y", 6, 60)]


@pytest.mark.parametrize("top", [2, 5, 20])
@pytest.mark.parametrize("batch", [4, 10000])
def test_against_brute_force(spark, top, batch):
    rng = random.Random(top * batch)
    rows = []
    for _ in range(500):
        a = rng.randrange(-40, 900)
        rows.append((rng.choice("xyz"), rng.choice("uv"), a, a + rng.choice([0, -3, 1, 2, 16, 32, rng.randrange(1, 60)])))
    rows += rows[:30] + [(None, "u", 1, 5), ("x", None, 1, 5), ("x", "u", None, 5), ("x", "u", 5, None), ("w", "u", 0, 4096)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, IV).withColumn("b", F.lit("clash")).withColumn("k0", F.lit(1)).withColumn("piece", F.lit(1))
    got = periods_and_gaps(df, ["session_id", "speaker"], top=top).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows)


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], IV), ["session_id", "speaker"]).count() == 0


def test_long_intervals_have_few_blocks(spark):
    """A year, and times in seconds since 1970: the level of the largest block follows, the periods are the same."""
    year = 365 * 86_400_000
    at = 1_700_000_000_000
    rows = [("s", "p", at, at + year), ("s", "p", at + year, at + year + 5), ("s", "p", at + 2 * year, at + 2 * year + 1), ("s", "p", at + 7, at + 900)]
    rows += [("t", "p", at + 10 * i, at + 10 * i + 10 + i % 2) for i in range(50)]
    top = dyadic.top_level(year)
    assert top > dyadic.TOP and len(dyadic_blocks(np.array([at]), np.array([at + year]), top)[1]) < 1200
    got = periods_and_gaps(spark.createDataFrame(rows, IV), ["session_id", "speaker"])
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert dyadic.top_level(None) == dyadic.TOP and dyadic.top_level(1 << 62) == dyadic.HIGHEST
