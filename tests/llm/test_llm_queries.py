"""Every query of the problems runs on the smallest tables; those with SQL equal it."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from turnloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["item_id", "action"],
    "p3_found": ["event_id", "chunk_id"],
    "p4_found": ["source", "elapsed_stratum"],
    "p5_found": ["session_id", "turn_speaker", "opening_line_id", "n_lines"],
    "p6_found": ["lineage_a", "lineage_b"],
    "p7_found": ["doc_id"],
    "p8_found": ["source"],
    "p9_found": ["doc_a", "doc_b"],
}


def rows(df):
    return Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tiny, name):
    out = QUERIES[name](spark, tiny)
    assert name not in COLUMNS or out.columns == COLUMNS[name]
    got = out.toPandas()
    if name in SQL:
        c = duckdb.connect()
        for f in Path(tiny).glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from '{f}'")
        assert rows(got) == rows(c.execute(SQL[name]).df())


def test_shortfalls_follow_the_definition(spark, tiny):
    from turnloom.llm.queries import _sources

    tokens = {}
    for r in _sources(spark, tiny).collect():
        tokens[(r["source"] or "").strip().lower()] = tokens.get((r["source"] or "").strip().lower(), 0) + r["n_tokens"]
    total = sum(tokens.values())
    goals = spark.read.parquet(f"{tiny}/mix_targets.parquet").collect()
    want = {g["source"] for g in goals if tokens.get(g["source"], 0) * g["max_repeats"] < g["target_bp"] / 10000 * total}
    assert {r["source"] for r in QUERIES["p8_found"](spark, tiny).collect()} == want
    short = {r["source"]: r["falls_short"] for r in QUERIES["p8_report"](spark, tiny).collect()}
    assert {s for s, x in short.items() if x} == want
