"""Every core query runs on the smallest tables and equals its SQL."""

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
CORE = [n for n in entry.queries() if not n.startswith("p") or n.startswith(("p2_", "prj"))]


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(tiny).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, tiny, duck, name):
    got = entry.queries()[name](spark, tiny).toPandas()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_subpackage():
    code = "import sys; sys.modules['turnloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_it():
    for f in [*ROOT.glob("*.py"), *(ROOT / "turnloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(ROOT).parts and f.name not in ("__spark_entry__.py", "test_queries.py"):
            assert "turnloom.llm" not in f.read_text(), f
