"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from textloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        held.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return held


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool | str):
        return x
    if isinstance(x, list):
        return tuple(map(plain, x))
    return round(float(x), 6)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    ours = QUERIES[name](spark, SF).toArrow()
    theirs = con.execute(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    names = sorted(ours.column_names)
    a, b = (Counter(tuple(plain(r[n]) for n in names) for r in t.to_pylist()) for t in (ours, theirs))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).toArrow() is not None


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["rank", "doc_id", "score", "snippet"]
    assert set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_corpus_operators(tmp_path):
    """Without the corpus folders the entry still imports and lists the engine's own queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], out.stderr
