"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import os

import duckdb
import pandas as pd
import pytest

from stratalake.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    one = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if x != y and any((isinstance(p, float) and isinstance(q, float) and abs(p - q) > 2e-5 * max(1, abs(q))) or (type(p) is not type(q)) or (not isinstance(p, float) and p != q) for p, q in zip(x, y))]
    assert not off, off[:3]


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).limit(1).count() == 1


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """The core neither imports nor needs it."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "stratalake", tmp_path / "stratalake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
