"""Every registered query of the library against its SQL in DuckDB, or run for its rows."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from corpusgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE:
        return
    cursor = duck.execute(catalog.ORACLE[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["corpusgraph/llm", "tests/llm"], ["corpusgraph/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_entry_without_optional_parts(tmp_path, gone):
    """The entry imports whichever of the optional parts were deleted, and has all other queries."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(top, tmp_path / "repo", ignore=lambda at, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(at, n), top) in gone])
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', *e.queries())"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert run.returncode == 0, run.stderr[-600:]
    names = set(run.stdout.split("NAMES")[1].split())
    assert set(catalog.QUERIES) <= names
    assert any(n.startswith("op1_") for n in names) == (os.path.isdir(os.path.join(top, "corpusgraph", "llm")) and "corpusgraph/llm" not in gone)
    assert "pipeline" not in names or not gone
